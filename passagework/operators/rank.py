"""Re-ranking candidates by a model, scheduled as grouped Arrow work.

A ranker gets a pool with its texts and returns (query_id, chunk_id, score).
The models themselves are callables that an executor loads once; none is part
of this package.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import fixed
from passagework.functions.words import words


class CloudRefused(RuntimeError):
    """Texts of a source that is not public would have left for a remote model."""


class Ranker(Protocol):
    name: str
    remote: bool

    def score(self, pool: DataFrame) -> DataFrame:
        """`pool`: query_id, question, chunk_id, seq, first, source, public, path, heading_path, text."""
        ...


def refuse_private(rows: DataFrame, name: str, remote: bool) -> None:
    """Raise before any work if a remote model would read a source that is not public; no row is dropped instead."""
    if not remote:
        return
    found = sorted(r.source for r in rows.where(~F.coalesce("public", F.lit(False))).select("source").distinct().limit(20).collect())
    if found:
        raise CloudRefused(f"{name!r} would send text of non-public source(s) {', '.join(found)} away; narrow the scope or use a local model")


def passage(path: Column, heading: Column, text: Column) -> Column:
    """A chunk as models read it: where it stands, then its text."""
    head = F.when(F.coalesce(heading, F.lit("")) != "", F.concat_ws(" > ", path, heading)).otherwise(path)
    return F.concat(F.lit("["), head, F.lit("]\n"), text)


class LexicalRanker:
    """A stand-in without a model: the share of the question's distinct words that the passage has. Runs in the JVM."""

    name, remote = "lexical", False

    def score(self, pool: DataFrame) -> DataFrame:
        asked = F.array_distinct(words(F.col("question")))
        has = F.size(F.array_intersect(asked, words(F.col("text"))))
        return pool.select("query_id", "chunk_id", F.when(F.size(asked) > 0, F.round(has / F.size(asked), 6)).alias("score"))


class PointwiseRanker:
    """One probability a (question, passage), asked by `threads` at a time; None where the model refuses."""

    def __init__(self, name: str, ask: Callable[[str, str], float | None], remote: bool, threads: int = 12):
        self.name, self.ask, self.remote, self.threads = name, ask, remote, threads

    def score(self, pool: DataFrame) -> DataFrame:
        refuse_private(pool, self.name, self.remote)
        ask, threads = self.ask, self.threads

        @F.pandas_udf("double")
        def asked(questions: pd.Series, passages: pd.Series) -> pd.Series:
            with ThreadPoolExecutor(threads) as pool_:
                return pd.Series(list(pool_.map(ask, questions, passages)), dtype="float64")

        told = asked.asNondeterministic()(F.col("question"), passage(F.col("path"), F.col("heading_path"), F.col("text")))
        return pool.select("query_id", "chunk_id", told.alias("score"))


class PassRanker:
    """One state of up to fifteen passages a pass; probabilities compare inside a pass only.

    A larger pool is read in heats of fifteen. A final pass reads the best of
    each heat and up to seven of the chunks that widening added; only it gives scores.
    `read(state, question, n)` returns the probabilities of the n passages.
    """

    def __init__(self, name: str, read: Callable[[str, str, int], list[float]], remote: bool = False):
        self.name, self.read, self.remote = name, read, remote

    def score(self, pool: DataFrame) -> DataFrame:
        refuse_private(pool, self.name, self.remote)
        heats, final = self.heats(pool)
        whole = pool.join(final, ["query_id", "chunk_id"], "left_semi")
        read = self.passes(whole.withColumn("heat", F.lit(0)))
        return read.select("query_id", "chunk_id", F.col("p").alias("score"))

    def heats(self, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(readings of the heats, (query_id, chunk_id) of the final pass)."""
        size = fixed.PASSAGES_A_PASS
        n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        rows = pool.withColumn("n", n).withColumn("first", F.least(F.coalesce("first", F.col("n")), F.col("n")))
        small = rows.where(F.col("n") <= size).select("query_id", "chunk_id")
        large = rows.where(F.col("n") > size).withColumn("heat", F.floor((F.col("seq") - 1) / size).cast("int"))
        read = self.passes(large.where(F.col("seq") <= F.col("first")))
        seats = size - F.least(F.lit(size // 2), F.col("n") - F.col("first"))
        count = F.ceil(F.col("first") / size).cast("int")
        take = F.floor(seats / count) + F.when(F.col("heat") < F.pmod(seats, count), 1).otherwise(0)
        shape = large.select("query_id", "chunk_id", "heat", "seq", take.alias("take"))
        ranked = read.where("p is not null").join(shape, ["query_id", "chunk_id", "heat"])
        best = ranked.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "heat").orderBy(F.desc("p"), "seq"))).where(F.col("k") <= F.col("take"))
        extra = large.where((F.col("seq") > F.col("first")) & (F.col("seq") <= F.col("first") + size // 2))
        return read, small.unionByName(best.select("query_id", "chunk_id")).unionByName(extra.select("query_id", "chunk_id"))

    def passes(self, rows: DataFrame) -> DataFrame:
        """(query_id, heat, chunk_id, p): the rows of each query and heat read as one state; passages that don't fit are not read."""
        read = self.read
        states = render(rows)

        @F.pandas_udf("array<double>")
        def told(state: pd.Series, question: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([read(s, q[: fixed.QUERY_CHARS], int(k)) for s, q, k in zip(state, question, n)])

        answered = states.withColumn("ps", told.asNondeterministic()("state", "question", F.size("chunks")))
        seats = answered.select("query_id", "heat", F.explode(F.arrays_zip("chunks", "ps")).alias("x"))
        return seats.select("query_id", "heat", F.col("x.chunks").alias("chunk_id"), F.col("x.ps").alias("p"))


def render(rows: DataFrame, most_chars: int = fixed.STATE_CHARS) -> DataFrame:
    """(query_id, heat, question, state, chunks, lines): states of at most fifteen passages in the order of `seq`.

    Passages are `P01 [path > heading]`, lines that are not blank `L000| text`,
    numbered through the state. The last passages are left out until the state
    fits, down to two. `lines` has the number of lines of each passage.
    """
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    order = Window.partitionBy("query_id", "heat").orderBy("seq")
    numbered = rows.withColumn("seat", F.row_number().over(order)).withColumn("body", kept)
    before = F.coalesce(F.sum(F.size("body")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.withColumn("at", before)
    lines = F.transform("body", lambda x, i: F.concat(F.format_string("L%03d", (F.col("at") + i).cast("int")), F.lit("| "), F.rtrim(x)))
    head = F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat_ws(" > ", "path", "heading_path")).otherwise(F.col("path"))
    told = F.concat_ws("\n", F.concat(F.format_string("P%02d", F.col("seat")), F.lit(" ["), head, F.lit("]")), lines)
    told = numbered.withColumn("told", told)
    length = F.sum(F.char_length("told") + 2).over(order) - 2
    fits = told.withColumn("length", length).where((F.col("length") <= most_chars) | (F.col("seat") <= 2))
    one = F.array_sort(F.collect_list(F.struct("seat", "chunk_id", "told", F.size("body").alias("lines"))))
    states = fits.groupBy("query_id", "heat").agg(F.first("question").alias("question"), one.alias("x"))
    return states.select("query_id", "heat", "question", F.array_join(F.transform("x", lambda r: r["told"]), "\n\n").alias("state"), F.transform("x", lambda r: r["chunk_id"]).alias("chunks"), F.transform("x", lambda r: r["lines"]).alias("lines"))


def overlap_reader(state: str, question: str, n: int) -> list[float]:
    """A stand-in reader: probabilities by how many of the question's words each passage of the state has."""
    import re

    asked = set(re.findall(r"\w+", question.lower()))
    parts = re.split(r"(?m)^P\d\d (?=\[)", state)[1:]
    counts = [len(asked & set(re.findall(r"\w+", p.lower()))) for p in parts]
    return softmax(np.array(counts[:n], float)).tolist()


# ---------------------------------------------------------------- questions and answers of a model


def pass_questions(question: str, passages: list[str], lines: list[str], with_line: bool = True, with_exists: bool = True) -> dict:
    """The questions asked of one state: which passage, whether any, and which line if the lines are few enough."""
    q = question[: fixed.QUERY_CHARS]
    asked: dict = {"where_passage": {"type": "choice", "instructions": f'In which passage is this answered: "{q}"', "criteria": dict.fromkeys(passages)}}
    if with_exists:
        asked["exists"] = {"type": "noul", "instructions": f'Is this answered in one of the passages: "{q}"', "criteria": {"true": "a passage says it or implies it", "false": "no passage is about it"}}
    if with_line and len(lines) <= fixed.OPTIONS:
        asked["where_line"] = {"type": "choice", "instructions": f'In which line is this answered: "{q}"', "criteria": dict.fromkeys(lines)}
    return asked


# What one passage may be to another, for someone who asks a question.
RELATIONS = ("carries it out", "defines a name in it", "nothing to follow", "rule it follows", "where it failed", "why it is so")


def relation_questions(question: str, passages: list[str], pairs: list[tuple[int, int]]) -> dict:
    """One choice a pair over a single state of at most fifteen passages; pairs beyond it are not asked."""
    q, held = question[: fixed.QUERY_CHARS], passages[: fixed.PASSAGES_A_PASS]
    asked = [(held[a], held[b]) for a, b in pairs if a < len(held) and b < len(held)]
    return {f"{a}>{b}": {"type": "choice", "instructions": f'To someone who asks "{q}", what is passage {b} to passage {a}?', "criteria": dict.fromkeys(RELATIONS)} for a, b in asked}


def asked_relations(states: DataFrame, ask: Callable[[str, dict], dict]) -> DataFrame:
    """(query_id, a, b, relation, p): what passages are to one another, by `ask(state, questions)` over each state.

    `states` is (query_id, question, state, passages: array of names, pairs:
    array of (a, b) places). An answer is a dict of probabilities by relation
    for each question; a question without one has no row.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                asked = relation_questions(r.question or "", list(r.passages), [(p["a"], p["b"]) for p in r.pairs])
                for key, answer in (ask(r.state, asked) if asked else {}).items():
                    a, b = key.split(">", 1)
                    out += [(r.query_id, a, b, relation, float(p)) for relation, p in answer.items()]
            yield pd.DataFrame(out, columns=["query_id", "a", "b", "relation", "p"])

    rows = states.select("query_id", "question", "state", "passages", "pairs")
    return rows.mapInPandas(run, f"query_id {states.schema['query_id'].dataType.simpleString()}, a string, b string, relation string, p double")


class TypePredictor:
    """Probabilities of document types of a question, by a callable `predict(question, types)`."""

    def __init__(self, predict: Callable[[str, list[str]], dict[str, float]]):
        self.predict = predict

    def probabilities(self, queries: DataFrame, types: list[str]) -> DataFrame:
        """(query_id, type, p) of `queries` (query_id, text), as widening by type takes them."""
        predict = self.predict

        @F.pandas_udf("map<string,double>")
        def told(questions: pd.Series) -> pd.Series:
            return pd.Series([predict(q or "", types) for q in questions])

        return queries.select("query_id", F.explode(told.asNondeterministic()("text")).alias("type", "p"))


def line_owner(line_counts: list[int], line: int) -> int | None:
    """The passage that a line of the state belongs to."""
    at = 0
    for i, n in enumerate(line_counts):
        at += n
        if line < at:
            return i
    return None


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max()) if len(x) else x
    return e / e.sum() if len(x) else x


def pointer_probabilities(options: np.ndarray, decide: np.ndarray, keys: np.ndarray, queries: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Probabilities of options by a pointer head: scaled products of projected states."""
    scores = (options @ keys.T) @ (queries @ decide) / math.sqrt(keys.shape[0])
    return softmax(scores / temperature)


def shaped_answer(kind: str, probabilities: dict[str, float]) -> dict:
    """A model's answer to one question, to four places: yes/no, a choice, or the expected level of a scale."""
    p = {k: round(float(v), 4) for k, v in probabilities.items()}
    if kind == "noul":
        return {"noul": p.get("true", 0.0), "confidence": round(max(p.values(), default=0.0), 4)}
    if kind == "score":
        return {"score": round(sum(float(k) * v for k, v in probabilities.items()), 4), "probabilities": p}
    best = max(probabilities, key=probabilities.get) if probabilities else None
    return {"choice": best, "confidence": p.get(best, 0.0) if best else 0.0, "probabilities": p}


def token_batches(lengths: list[int], budget: int = 16_384) -> Iterator[list[int]]:
    """Rows in order, in batches whose padded size stays within the budget; a longer row is alone."""
    batch: list[int] = []
    longest = 0
    for i, n in enumerate(lengths):
        if batch and max(longest, n) * (len(batch) + 1) > budget:
            yield batch
            batch, longest = [], 0
        batch.append(i)
        longest = max(longest, n)
    if batch:
        yield batch


_RANKERS: dict[str, Callable[[], Ranker]] = {"lexical": LexicalRanker, "overlap": lambda: PassRanker("overlap", overlap_reader)}


def register_ranker(name: str, make: Callable[[], Ranker]) -> None:
    if name in _RANKERS or name == "none":
        raise ValueError(f"ranker {name!r} is taken")
    _RANKERS[name] = make


def make_ranker(name: str | None) -> Ranker | None:
    if name in (None, "none"):
        return None
    if name not in _RANKERS:
        raise ValueError(f"unknown ranker {name!r}; choose from {', '.join(['none', *sorted(_RANKERS)])}")
    return _RANKERS[name]()


def ranker_tag(run: str) -> str:
    """The last part of a run's path: what caches are kept under."""
    return run.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]


def caveat(exists: float | None, threshold: float | None) -> str | None:
    """A note for the reader where the model doubts that any passage answers."""
    if exists is None or threshold is None or exists >= threshold:
        return None
    return f"the passages may not answer this (p={exists:.2f}, below {threshold:g})"
