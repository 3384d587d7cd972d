"""What a judge says of chunks: content categories, and links between chunks about the same thing.

Judgments are kept by the hash of what was asked, so a rerun asks nothing
again; pairs that were judged either way round are known.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions import fixed
from passagework.operators import bm25, widen
from passagework.operators.index import Index
from passagework.operators.rank import passage, refuse_private
from passagework.session import materialize

JUDGMENT = "kind string, question string, passage string, other string, key string, p double, model string, source string"
SAME = "same_thing"


class Judge(Protocol):
    name: str
    remote: bool

    def categories(self, passages: DataFrame) -> DataFrame:
        """(passage) -> (passage, category, p) for every category."""
        ...

    def query_categories(self, queries: DataFrame) -> DataFrame:
        """(question) -> (question, category, p)."""
        ...

    def same(self, pairs: DataFrame) -> DataFrame:
        """(passage, other) -> (passage, other, p): do both state something of the same thing?"""
        ...


class CueJudge:
    """A stand-in without a model: cue words for categories, shared words for pairs. Runs in the JVM."""

    name, remote = "cues", False
    # Cue words, by category in order.
    CUES = {
        "Rule": "must|may|policy|limit|threshold|approves?|rejects?",
        "Procedure": "when|if|run|retry|write|block|step|schedule",
        "Reference": "table|column|field|schema|index|definition|null",
        "Explanation": "because|since|why|reason|despite",
        "Finding": "counts?|measures?|scores?|compares?|ranks?",
        "Record": "status|comment|report|was|were|open|done",
        "Other": "summary|list|label",
    }

    def _spread(self, rows: DataFrame, text: str) -> DataFrame:
        counts = {c: F.regexp_count(F.lower(F.col(text)), F.lit(rf"\b(?:{cue})\b")) for c, cue in self.CUES.items()}
        told = rows.withColumn("counts", F.array(*[F.struct(F.lit(c).alias("category"), (n + 1).alias("n")) for c, n in counts.items()]))
        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        each = told.select(text, total.alias("total"), F.explode("counts").alias("c"))
        return each.select(text, F.col("c.category").alias("category"), F.round(F.col("c.n") / F.col("total"), 6).alias("p"))

    def categories(self, passages: DataFrame) -> DataFrame:
        return self._spread(passages.select("passage"), "passage")

    def query_categories(self, queries: DataFrame) -> DataFrame:
        return self._spread(queries.select("question"), "question")

    def same(self, pairs: DataFrame) -> DataFrame:
        from passagework.functions.words import words

        a, b = F.array_distinct(words(F.col("passage"))), F.array_distinct(words(F.col("other")))
        both = F.size(F.array_intersect(a, b))
        return pairs.select("passage", "other", F.round(both / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)), 6).alias("p"))


class BatchJudge:
    """A judge by a callable: `ask(kind, items)` gets up to `window` items at a time and answers each, in order.

    An item is a text, or a pair of texts for `same`; an answer is a dict of
    probabilities by category, or a probability for `same`. None is a
    refusal. Items of a window that fails are not answered. Neither gives
    a row, so that they are asked again the next time; `refused` and `failed`
    count them over all tasks.
    """

    def __init__(self, name: str, ask: Callable[[str, list], list], spark: SparkSession, window: int = 32, remote: bool = False):
        self.name, self.ask, self.window, self.remote = name, ask, window, remote
        self.refused, self.failed = (spark.sparkContext.accumulator(0) for _ in range(2))

    def _answers(self, rows: DataFrame, columns: list[str], kind: str, fields: str, told: Callable) -> DataFrame:
        ask, window, refused, failed = self.ask, self.window, self.refused, self.failed

        def run(batches):
            for pdf in batches:
                items = [tuple(r) for r in pdf[columns].itertuples(index=False)]
                out = []
                for at in range(0, len(items), window):
                    some = items[at : at + window]
                    try:
                        answers = ask(kind, [x if len(x) > 1 else x[0] for x in some])
                    except Exception:  # noqa: BLE001 - counted; the others go on
                        failed.add(len(some))
                        continue
                    for item, answer in zip(some, answers, strict=True):
                        if answer is None:
                            refused.add(1)
                        else:
                            out += [(*item, *more) for more in told(answer)]
                yield pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

        return rows.select(*columns).distinct().mapInPandas(run, fields)

    @staticmethod
    def _by_category(answer: dict[str, float]) -> list[tuple[str, float]]:
        return [(c, round(float(answer.get(c, 0.0)), 6)) for c in fixed.CATEGORIES]

    def categories(self, passages: DataFrame) -> DataFrame:
        return self._answers(passages, ["passage"], "category", "passage string, category string, p double", self._by_category)

    def query_categories(self, queries: DataFrame) -> DataFrame:
        return self._answers(queries, ["question"], "query_category", "question string, category string, p double", self._by_category)

    def same(self, pairs: DataFrame) -> DataFrame:
        return self._answers(pairs, ["passage", "other"], SAME, "passage string, other string, p double", lambda p: [(round(float(p), 6),)])


def judgment_key(kind: Column, question: Column, text: Column, other: Column) -> Column:
    return F.sha1(F.concat_ws("\u001f", kind, question, text, other).cast("binary"))


def category_order(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in fixed.CATEGORIES]), category)


def kept_category(rows: DataFrame, by: list[str]) -> DataFrame:
    """`rows` (by, category, p) with `kept`: the likeliest category, unless it is Other; ties go by their order."""
    best = F.max_by("category", F.struct("p", (-category_order(F.col("category"))).alias("o"))).over(Window.partitionBy(*by))
    return rows.withColumn("kept", (F.col("category") == best) & (F.col("category") != fixed.NO_CATEGORY))


def prose_chunks(corpus) -> DataFrame:
    """(chunk_id, file_id, source, public, type, passage, text): prose chunks and the cards of datasets."""
    rows = corpus.placed("heading_path").where(F.col("lang").isin("markdown", "text") | (F.col("type") == fixed.DATASET))
    rows = rows.join(corpus.chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    return rows.select("chunk_id", "file_id", "source", "public", "type", passage(F.col("path"), F.col("heading_path"), F.col("text")).alias("passage"), "text")


def stale(categories: DataFrame) -> DataFrame:
    """(chunk_id): chunks with a category of another scheme."""
    return categories.where(~F.col("category").isin(*fixed.CATEGORIES)).select("chunk_id").distinct()


def categorize(corpus, judge: Judge, judgments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(categories, new judgments): chunk_id, category, p, kept, model of every prose chunk that has none yet.

    Cards of datasets are filed under Reference without asking. Chunks whose
    text was judged before by the same model are read from the judgments; only
    the rest is sent to the judge, once a text.
    """
    rows = prose_chunks(corpus)
    if corpus.categories is not None:
        known = corpus.categories.select("chunk_id").distinct().join(stale(corpus.categories), "chunk_id", "left_anti")
        rows = rows.join(known, "chunk_id", "left_anti")
    rows = materialize(rows.drop("text"), "prose")
    cards, asked = rows.where(F.coalesce("type", F.lit("")) == fixed.DATASET), rows.where(F.coalesce("type", F.lit("")) != fixed.DATASET)
    refuse_private(asked, judge.name, judge.remote)
    names = F.array(*[F.lit(c) for c in fixed.CATEGORIES])
    filed = cards.select("chunk_id", F.explode(names).alias("category")).withColumn("p", (F.col("category") == "Reference").cast("double"))
    filed = filed.select("chunk_id", "category", "p", F.col("p").cast("boolean").alias("kept"), F.lit("code").alias("model"))
    texts = asked.groupBy("passage").agg(F.min("source").alias("source"))
    held = _known(judgments, "category", judge.name, rows.sparkSession)
    cached = texts.join(held.select("passage", F.col("question").alias("category"), "p"), "passage")
    fresh = materialize(judge.categories(texts.select("passage").join(held.select("passage"), "passage", "left_anti")), "judged")
    told = kept_category(cached.select("passage", "category", "p").unionByName(fresh.select("passage", "category", "p")), ["passage"])
    chunks = asked.select("chunk_id", "passage").join(told, "passage").select("chunk_id", "category", "p", "kept", F.lit(judge.name).alias("model"))
    new = fresh.join(texts, "passage").select(
        F.lit("category").alias("kind"), F.col("category").alias("question"), "passage", F.lit("").alias("other"), judgment_key(F.lit("category"), F.col("category"), F.col("passage"), F.lit("")).alias("key"), "p", F.lit(judge.name).alias("model"), "source"
    )
    return filed.unionByName(chunks), new


def _known(judgments: DataFrame | None, kind: str, model: str, spark) -> DataFrame:
    if judgments is None:
        return spark.createDataFrame([], JUDGMENT)
    return judgments.where((F.col("kind") == kind) & (F.col("model") == model))


def candidates(corpus, index: Index, depth: int = fixed.NEIGHBOUR_DEPTH) -> DataFrame:
    """(a, b, rank): for each categorised chunk the chunks of its source, of other files and of another
    category that BM25 finds among the best `depth` by its most distinctive words."""
    kept = corpus.categories.where("kept").select("chunk_id", "category")
    rows = materialize(prose_chunks(corpus).join(kept, "chunk_id").select("chunk_id", "text"), "prose")
    # Frequencies here are those among the categorised chunks.
    from passagework.functions.words import WORD

    said = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda w: F.char_length(w) > 1)
    # Texts are moved once; their words are counted and ranked where they lie.
    tf = rows.select("chunk_id", "text").repartition("chunk_id").select("chunk_id", F.explode(said).alias("word")).groupBy("chunk_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = bm25.sent(materialize(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df >= 2"), "df"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    weight = F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), bm25.PLACES)
    best = tf.join(df, "word").crossJoin(F.broadcast(n)).withColumn("weight", weight)
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("weight"), "word"))).where(F.col("k") <= fixed.NEIGHBOUR_TERMS)
    asked = best.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("text"))
    placed = corpus.placed().select("chunk_id", F.col("source_id").alias("part"), "file_id")
    own = placed.select(F.col("chunk_id").alias("query_id"), "part", F.col("file_id").alias("own_file"))
    asked = asked.withColumnRenamed("chunk_id", "query_id").join(own.drop("own_file"), "query_id")
    asked = materialize(asked, "asked")
    found = bm25.best(index, bm25.query_phrases(asked, phrases=False), depth, asked.select("query_id", "part"), placed.select("chunk_id", "part"))
    near = found.join(placed.drop("part"), "chunk_id").join(own.drop("part"), "query_id")
    category = kept.withColumnRenamed("category", "their")
    mine = kept.select(F.col("chunk_id").alias("query_id"), F.col("category").alias("own"))
    other = near.where("file_id <> own_file").join(category, "chunk_id").join(mine, "query_id").where("own <> their")
    return other.select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"), F.col("bm25_rank").alias("rank"))


def planned_pairs(candidate_rows: DataFrame, most: int = fixed.NEIGHBOURS_A_SEED) -> DataFrame:
    """(a, b): the pairs that chunks seek in order of id, each taking its first `most` candidates not yet sought.

    An unordered pair belongs to the smaller seeker that took it, and the other
    refills. What a chunk takes depends on smaller ids only, so repeating the
    choice from the last result settles, from small ids up, in at most as many
    rounds as the longest chain of chunks that wait for one another. A round
    only chooses anew for chunks that have lost or won back a candidate; it
    goes on until there are none. No source is ever gathered in one task.
    """
    rows = materialize(candidate_rows, "candidates")
    mutual = rows.alias("x").join(rows.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.b < x.a")
    # (a, b) can be taken from `a` only by a smaller `b` that seeks `a` too.
    contested = materialize(mutual.select("x.a", "x.b"), "contested")

    def chosen(free: DataFrame) -> DataFrame:
        w = Window.partitionBy("a").orderBy("rank", "b")
        return free.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("a", "b", "rank")

    taken = materialize(chosen(rows), "taken")
    lost = contested.where(F.lit(False))
    while True:
        now = materialize(contested.join(taken.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi"), "lost")
        moved = materialize(now.join(lost, ["a", "b"], "left_anti").unionByName(lost.join(now, ["a", "b"], "left_anti")).select("a").distinct(), "moved")
        if moved.isEmpty():
            return taken
        anew = chosen(rows.join(moved, "a", "left_semi").join(now, ["a", "b"], "left_anti"))
        taken = materialize(taken.join(moved, "a", "left_anti").unionByName(anew), "taken")
        lost = now


def link_facts(corpus, index: Index, judge: Judge, judgments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, new judgments): `about` links between chunks that the judge says state the same thing."""
    rows = prose_chunks(corpus)
    refuse_private(rows, judge.name, judge.remote)
    kept = corpus.categories.where("kept").select("chunk_id", "category")
    pairs = planned_pairs(candidates(corpus, index))
    side = rows.select("chunk_id", "passage", "source").join(kept, "chunk_id")
    named = pairs.join(side.select(F.col("chunk_id").alias("a"), F.col("passage"), "source", F.col("category").alias("ca")), "a").join(side.select(F.col("chunk_id").alias("b"), F.col("passage").alias("other"), F.col("category").alias("cb")), "b")
    held = _known(judgments, SAME, judge.name, rows.sparkSession).select("passage", "other", "p").dropDuplicates(["passage", "other"])
    back = held.select(F.col("passage").alias("other"), F.col("other").alias("passage"), F.col("p").alias("p_back"))
    looked = named.join(held, ["passage", "other"], "left").join(back, ["passage", "other"], "left").withColumn("known", F.coalesce("p", "p_back")).drop("p", "p_back")
    fresh = materialize(judge.same(looked.where("known is null").select("passage", "other").distinct()), "judged")
    told = looked.join(fresh.select("passage", "other", F.col("p").alias("fresh")), ["passage", "other"], "left").withColumn("p", F.coalesce("known", "fresh"))
    via = F.concat_ws("~", F.least("ca", "cb"), F.greatest("ca", "cb"))
    links = told.where(F.col("p") >= fixed.KEEP_P).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("about").alias("rel"), via.alias("via"))
    source = named.groupBy("passage").agg(F.min("source").alias("source"))
    new = fresh.join(source, "passage").select(F.lit(SAME).alias("kind"), F.lit(SAME).alias("question"), "passage", "other", judgment_key(F.lit(SAME), F.lit(SAME), F.col("passage"), F.col("other")).alias("key"), "p", F.lit(judge.name).alias("model"), "source")
    return links.distinct(), new


def query_categories(judge: Judge, queries: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """(query_id, category): at most one kept category of each query; `queries` is (query_id, text)."""
    asked = queries.select("query_id", F.col("text").alias("question"))
    held = _known(judgments, "query_category", judge.name, queries.sparkSession)
    cached = asked.select("question").distinct().join(held.select(F.col("passage").alias("question"), F.col("question").alias("category"), "p"), "question")
    fresh = judge.query_categories(asked.select("question").distinct().join(cached.select("question"), "question", "left_anti"))
    told = kept_category(cached.unionByName(fresh.select("question", "category", "p")), ["question"]).where("kept")
    return asked.join(told.select("question", "category"), "question").select("query_id", "category")


def build(corpus, index: Index, judge: Judge, judgments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Categories, `about` links and new judgments of a map."""
    categories, told = categorize(corpus, judge, judgments)
    categories = materialize(categories, "categories")
    whole = categories if corpus.categories is None else corpus.categories.join(stale(corpus.categories), "chunk_id", "left_anti").unionByName(categories)
    links, judged = link_facts(corpus.with_(categories=whole), index, judge, judgments)
    return {"categories": whole, "links": links, "judgments": told.unionByName(judged)}


def category_counts(categories: DataFrame) -> DataFrame:
    return categories.where("kept").groupBy("category").agg(F.count(F.lit(1)).alias("chunks"))


def widened(corpus, index: Index, queries: DataFrame, pool: DataFrame, judge: Judge, limit: int = 10) -> DataFrame:
    return widen.by_facts(corpus, index, queries, pool, query_categories(judge, queries), limit)
