"""Measures of retrieval and of judgments, each as one aggregation over all questions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.words import SPACE
from passagework.operators import logistic
from passagework.operators.links import overlap
from passagework.operators.numbering import numbered
from passagework.session import materialize


def bench_rows(spark: SparkSession, path: str) -> DataFrame:
    """(question, source, path, start_line, end_line) of a JSON-lines file of either shape: spelled out, or
    `query` with `answer` as `source:path:line`."""
    raw = spark.read.schema("question string, query string, source string, path string, start_line int, end_line int, answer string").json(path)
    line = F.regexp_extract("answer", r":(\d+)$", 1).cast("int")
    has = F.col("answer").isNotNull()
    return raw.select(
        F.coalesce("question", "query").alias("question"),
        F.when(has, F.split_part("answer", F.lit(":"), F.lit(1))).otherwise(F.col("source")).alias("source"),
        F.when(has, F.split_part("answer", F.lit(":"), F.lit(2))).otherwise(F.col("path")).alias("path"),
        F.when(has, line).otherwise(F.col("start_line")).alias("start_line"),
        F.when(has, line).otherwise(F.col("end_line")).alias("end_line"),
    )


def beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a folder in that layout; queries without a relevant document are left out."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    qrels = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc"), F.col("score").alias("gain")).where("gain > 0")
    asked = queries.select(F.col("_id").alias("query_id"), "text").join(qrels, "query_id", "left_semi")
    return corpus.select(F.col("_id").alias("doc"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")), asked, qrels


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.col("query_id").alias("query-id"), F.col("doc").alias("corpus-id"), F.col("gain").alias("score")).write.csv(path, sep="\t", header=True)


def gold_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank): the first hit that shares a line with the answer; null where none does.

    `hits`: query_id, seq, source, path, start_line, end_line; `gold`: query_id, source, path, start_line, end_line.
    """
    g = gold.select("query_id", "source", "path", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))
    met = hits.join(g, ["query_id", "source", "path"]).where(overlap(F.col("start_line"), F.col("end_line"), F.col("gs"), F.col("ge")))
    return gold.select("query_id").distinct().join(met.groupBy("query_id").agg(F.min("seq").alias("rank")), "query_id", "left")


def ndcg_one(rank: Column) -> Column:
    """nDCG@10 of a single answer."""
    return F.when(rank <= 10, 1 / F.log2(rank + 1.0)).otherwise(0.0)


def rank_summary(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, in_pool, top1, top5, top10, ndcg10, mrr10 over (query_id, rank), by arm if asked."""
    at = lambda k: F.count_if(F.col("rank") <= k)
    return ranks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("rank").alias("in_pool"),
        at(1).alias("top1"),
        at(5).alias("top5"),
        at(10).alias("top10"),
        F.round(F.avg(ndcg_one(F.col("rank"))), 4).alias("ndcg10"),
        F.round(F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)), 4).alias("mrr10"),
    )


def question_rows(hits: DataFrame, gold: DataFrame, base_ranks: DataFrame) -> DataFrame:
    """One row a question: rank, how the answer entered, whether BM25 alone had it, the ten best."""
    ranks = gold_ranks(hits, gold)
    via = hits.select("query_id", F.col("seq").alias("rank"), "via")
    coord = F.concat(F.col("source"), F.lit(":"), F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"))
    ten = hits.where("seq <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", coord.alias("c")))), lambda x: x["c"]).alias("top10"))
    base = base_ranks.select("query_id", F.col("rank").isNotNull().alias("in_bm25"))
    return ranks.join(via, ["query_id", "rank"], "left").join(base, "query_id", "left").join(ten, "query_id", "left").select("query_id", "rank", F.coalesce("via", F.lit("")).alias("via"), F.coalesce("in_bm25", F.lit(False)).alias("in_bm25"), "top10")


def how_found(rows: DataFrame) -> DataFrame:
    """(how, n): how the answers among the ten best entered the pool."""
    how = F.when(F.col("via") == "", "bm25").otherwise(F.split_part("via", F.lit(":"), F.lit(1)))
    return rows.where("rank <= 10").groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("n"))


def collapsed(hits: DataFrame, doc: str) -> DataFrame:
    """(query_id, doc, rank): documents in the order of their first hit."""
    first = hits.groupBy("query_id", F.col(doc).alias("doc")).agg(F.min("seq").alias("seq"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seq", "doc"))).drop("seq")


def graded(run: DataFrame, qrels: DataFrame, binary: bool = False) -> DataFrame:
    """(query_id, ndcg10, recall, recall10) of `run` (query_id, doc, rank) by `qrels` (query_id, doc, gain).

    Gains are 2^g - 1, or 1 each with `binary`. Questions that found nothing count as 0.
    """
    gain = F.lit(1.0) if binary else F.pow(F.lit(2.0), F.col("gain")) - 1
    judged = qrels.join(run, ["query_id", "doc"], "left")
    ideal = judged.withColumn("best", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc")))
    dcg = F.sum(F.when(F.col("rank") <= 10, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    most = F.sum(F.when(F.col("best") <= 10, gain / F.log2(F.col("best") + 1.0)).otherwise(0.0))
    return ideal.groupBy("query_id").agg(
        F.round(F.when(most > 0, dcg / most).otherwise(0.0), 6).alias("ndcg10"),
        F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("recall"),
        F.round(F.count_if(F.col("rank") <= 10) / F.count(F.lit(1)), 6).alias("recall10"),
    )


def paired(a: DataFrame, b: DataFrame, value: str, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """(wins, losses, ties, mean_diff, low, high): `b` against `a` on the same questions, with a bootstrap interval.

    The differences of a benchmark's questions are one group: a fixed,
    documented question set, not data that grows.
    """
    both = a.select("query_id", F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id").select(F.lit(0).alias("g"), "query_id", (F.col("y") - F.col("x")).alias("d"))

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("query_id")["d"].to_numpy()
        draws = random.Random(seed)
        # Fixed by the order of its draws: one index after another, sample by sample.
        picks = np.fromiter((draws.randrange(len(d)) for _ in range(n_boot * len(d))), np.int64).reshape(n_boot, len(d))
        means = np.sort(d[picks].mean(axis=1))
        edges = means[int(0.025 * n_boot)], means[int(0.975 * n_boot) - 1]
        numbers = [d.mean(), *edges]
        return pd.DataFrame([[*(int(x) for x in ((d > 0).sum(), (d < 0).sum(), (d == 0).sum())), *(round(float(x), 4) for x in numbers)]], columns=["wins", "losses", "ties", "mean_diff", "low", "high"])

    return both.groupBy("g").applyInPandas(told, "wins long, losses long, ties long, mean_diff double, low double, high double")


def gate(a: DataFrame, b: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(n, top1_a, top1_b, diff, low, high, wins, losses): the first places of two runs on the questions that both answered.

    `a` and `b` are (query_id, top1 as 0 or 1, null where the question was not asked).
    """
    said = lambda run: run.where("top1 is not null").select("query_id", F.col("top1").cast("double").alias("top1"))
    both = said(a).join(said(b).withColumnRenamed("top1", "other"), "query_id")
    shares = both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top1"), 3).alias("top1_a"), F.round(F.avg("other"), 3).alias("top1_b"))
    told = paired(said(b), said(a), "top1", n_boot, seed)
    return shares.crossJoin(told.select(F.round("mean_diff", 3).alias("diff"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "wins", "losses"))


def paired_counts(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(wins, losses, ties, mean_diff) of any number of questions."""
    d = a.select("query_id", F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id").select((F.col("y") - F.col("x")).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), F.round(F.avg("d"), 4).alias("mean_diff"))


def auc(rows: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """(auc) of scores against a flag, ties counting half; null without both kinds.

    Scores are ranked as they are. Sums run first over scores rounded to four
    places, then inside each of these, so no task sorts all scores of a group.
    """
    by = by or []
    counted = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    counted = counted.withColumn("near", F.round("s", 4))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counted.groupBy(*by, "near").agg(F.sum("neg").alias("neg")).select(*[F.col(k).alias(f"step_{k}") for k in (*by, "near")], before(Window.partitionBy(*by).orderBy("near")).alias("lower"))
    same = F.lit(True)
    for k in (*by, "near"):
        same = same & F.col(k).eqNullSafe(F.col(f"step_{k}"))
    below = F.col("lower") + before(Window.partitionBy(*by, "near").orderBy("s"))
    won = counted.join(steps, same).withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.round(F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auc"))


def without_gold(pool: DataFrame, deeper: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """The pool of a question with its answers removed and refilled from the ranks below: its negative twin.

    `deeper` is the same ranking to a greater depth; `gold` is (query_id, chunk_id).
    """
    asked = pool.select("query_id").distinct()
    rest = deeper.join(asked, "query_id", "left_semi").join(gold.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("seq", "chunk_id")
    return rest.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "chunk_id", F.col("place").alias("seq"))


def swapped_slots(pool: DataFrame, spare: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, seq, chunk_id): the pool with each answer's place taken by the next spare hit, in order.

    A spare hit is one that is neither in the pool nor an answer. Places keep
    their numbers; an answer without a spare hit left leaves its place empty.
    """
    answers = gold.select("query_id", "chunk_id").distinct()
    place = Window.partitionBy("query_id").orderBy("seq", "chunk_id")
    slots = pool.join(answers, ["query_id", "chunk_id"], "left_semi").select("query_id", "seq", F.row_number().over(place).alias("k"))
    kept = pool.join(answers, ["query_id", "chunk_id"], "left_anti").select("query_id", "seq", "chunk_id")
    free = spare.join(pool, ["query_id", "chunk_id"], "left_anti").join(answers, ["query_id", "chunk_id"], "left_anti")
    fill = free.select("query_id", "chunk_id", F.row_number().over(place).alias("k"))
    return kept.unionByName(slots.join(fill, ["query_id", "k"]).select("query_id", "seq", "chunk_id"))


def _hash(key: Column, salt: str) -> Column:
    """The first eight hexadecimal digits of the hash of a key and its salt, as a number."""
    return F.conv(F.substring(F.sha1(F.concat(key, F.lit("\t"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_pick(key: Column, n: Column | int, salt: str) -> Column:
    """A number below `n` that depends on the key and the salt alone."""
    return _hash(key, salt) % n


# The salt of an order, and the steps in which its probability is counted.
ORDER_SALT, ORDER_STEPS = "order", 10_000


def arranged(pools: DataFrame, p: float) -> DataFrame:
    """`pools` (query_id, arm, seq, ...) with `seq` renumbered and `shuffled`: with probability `p`, by the hash of the
    question, all arms of a question have their places moved by one permutation.

    The permutation is as long as the longest arm; places that an arm lacks are left out.
    """
    h = _hash(F.col("query_id").cast("string"), ORDER_SALT)
    asked = pools.groupBy("query_id", "arm").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.max("n").alias("n"))

    @F.pandas_udf("array<int>")
    def permutation(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for seed, n in zip(seeds, sizes):
            places = list(range(n))
            random.Random(seed).shuffle(places)
            out.append(places)
        return pd.Series(out)

    moved = asked.withColumn("h", h).where(F.lit(p > 0) & (F.col("h") % ORDER_STEPS < p * ORDER_STEPS))
    moved = moved.select("query_id", F.posexplode(permutation("h", "n")).alias("to", "place"))
    placed = pools.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "arm").orderBy("seq")) - 1)
    told = placed.join(moved, ["query_id", "place"], "left")
    order = Window.partitionBy("query_id", "arm").orderBy(F.coalesce("to", "place"))
    return told.select(*[c for c in pools.columns if c != "seq"], F.row_number().over(order).alias("seq"), F.col("to").isNotNull().alias("shuffled"))


def spread(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(n, median, p90, mean) of a number."""
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.round(F.percentile(value, 0.5), 6).alias("median"), F.round(F.percentile(value, 0.9), 6).alias("p90"), F.round(F.avg(value), 6).alias("mean"))


def classification(rows: DataFrame, gold: str, said: str, by: str) -> DataFrame:
    """(by, n, accuracy, macro_f1): per stratum, F1 averaged over the classes that occur."""
    pairs = rows.select(by, F.explode(F.array_distinct(F.array(gold, said))).alias("class"), gold, said)
    cell = pairs.groupBy(by, "class").agg(F.count_if((F.col(gold) == F.col("class")) & (F.col(said) == F.col("class"))).alias("tp"), F.count_if(F.col(gold) == F.col("class")).alias("real"), F.count_if(F.col(said) == F.col("class")).alias("told"))
    f1 = cell.groupBy(by).agg(F.round(F.avg(2 * F.col("tp") / (F.col("real") + F.col("told"))), 6).alias("macro_f1"))
    acc = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(gold) == F.col(said)).cast("double")), 6).alias("accuracy"))
    return acc.join(f1, by)


# The thresholds of a calibration and of a curve, in hundredths; the bar of a class, and of a quiet reading.
CALIBRATED_AT = tuple(range(0, 100, 5))
CURVE_AT = tuple(range(5, 100, 5))
LEAST_PRECISION, LEAST_COVERAGE, QUIET_KEEPS = 0.95, 0.40, 0.9


def _at(hundredths: tuple[int, ...]) -> Column:
    return F.explode(F.array(*[F.lit(h / 100) for h in hundredths])).alias("threshold")


def calibration(rows: DataFrame, said: str, gold: str, p: str, ood: Column | None = None) -> DataFrame:
    """(class, threshold, n, kept, precision, ood_n, ood_kept, ood_precision): what is left of each class's predictions
    at each of twenty thresholds, over all and over those outside the domain (where `ood` holds; none without it).

    Every row is counted at every threshold inside one aggregate that combines
    before the shuffle; a class that holds a third of the rows is twenty rows a task there.
    """
    cut = rows.select(F.col(said).alias("class"), (F.col(said) == F.col(gold)).alias("right"), F.col(p).alias("p"), (F.lit(False) if ood is None else F.coalesce(ood, F.lit(False))).alias("ood"), _at(CALIBRATED_AT))
    kept = F.col("p") >= F.col("threshold")
    told = cut.groupBy("class", "threshold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & F.col("right")).alias("right"),
        F.count_if("ood").alias("ood_n"),
        F.count_if(kept & F.col("ood")).alias("ood_kept"),
        F.count_if(kept & F.col("right") & F.col("ood")).alias("ood_right"),
    )
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 3)
    return told.select("class", "threshold", "n", "kept", share("right", "kept").alias("precision"), "ood_n", "ood_kept", share("ood_right", "ood_kept").alias("ood_precision"))


def lowest_threshold(curve: DataFrame, precision: float = LEAST_PRECISION, coverage: float = LEAST_COVERAGE) -> DataFrame:
    """(class, tau): the lowest threshold at which the bar is met over all predictions of a class and over those outside the domain; null where none does."""
    met = F.lit(True)
    for part in ("", "ood_"):
        met = met & (F.col(f"{part}kept") > 0) & (F.col(f"{part}precision") >= precision) & (F.col(f"{part}kept") >= coverage * F.col(f"{part}n"))
    return curve.groupBy("class").agg(F.min(F.when(met, F.col("threshold"))).alias("tau"))


def threshold_curve(rows: DataFrame, p: str, answerable: str) -> DataFrame:
    """(threshold, keeps_answerable, flags_absent, balanced): which share of answerable questions reaches a threshold,
    which share of the others stays below it, and the mean of both."""
    cut = rows.select(F.col(answerable).alias("ok"), F.col(p).alias("p"), _at(CURVE_AT))
    keeps = F.count_if((F.col("p") >= F.col("threshold")) & F.col("ok")) / F.nullif(F.count_if("ok"), F.lit(0))
    flags = F.count_if((F.col("p") < F.col("threshold")) & ~F.col("ok")) / F.nullif(F.count_if(~F.col("ok")), F.lit(0))
    return cut.groupBy("threshold").agg(F.round(keeps, 3).alias("keeps_answerable"), F.round(flags, 3).alias("flags_absent"), F.round((keeps + flags) / 2, 3).alias("balanced"))


def threshold_points(curve: DataFrame, keeps: float = QUIET_KEEPS) -> DataFrame:
    """(balanced_point, quiet_point): the lowest threshold with the best balance, and the highest that keeps most
    answerable questions; the lowest of all where none does."""
    balanced = F.min_by("threshold", F.struct((-F.col("balanced")).alias("x"), "threshold"))
    quiet = F.coalesce(F.max(F.when(F.col("keeps_answerable") >= keeps, F.col("threshold"))), F.min("threshold"))
    return curve.agg(balanced.alias("balanced_point"), quiet.alias("quiet_point"))


def patch_files(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, path): files that a unified diff changes, by their old names."""
    found = patches.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^--- a/(\S+)"), F.lit(1)))).alias("path"))
    return found.where("path <> ''")


def touched_lines(diff: str | None) -> list[tuple[str, int]]:
    """(path, line) of every line of the old files that a unified diff removes or inserts next to; an insertion touches the lines on both sides."""
    out: list[tuple[str, int]] = []
    path, line = None, 0
    for row in (diff or "").split("\n"):
        if row.startswith("--- "):
            path = row[6:].split("\t")[0] if row.startswith("--- a/") else None
        elif row.startswith("@@ "):
            line = int(row.split()[1].split(",")[0].lstrip("-"))
        elif path is None or row.startswith(("+++ ", "diff ", "index ", "\\")):
            continue
        elif row.startswith("-"):
            out.append((path, line))
            line += 1
        elif row.startswith("+"):
            out += [(path, max(line - 1, 1)), (path, line)]
        elif row.startswith(" "):
            line += 1
    return sorted(set(out))


def touched(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, path, line) of the old lines that patches touch."""

    @F.pandas_udf("array<struct<path:string,line:int>>")
    def cut(diffs: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "line": n} for p, n in touched_lines(d)] for d in diffs])

    return patches.select(key, F.explode(cut(F.col(patch))).alias("t")).select(key, "t.path", "t.line")


def touched_chunks(touched_rows: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunk_id): chunks (chunk_id, path, start_line, end_line) that hold a touched line."""
    met = touched_rows.join(chunks, "path").where((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    return met.select(key, "chunk_id").distinct()


def even_sample(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """`n` rows of each group, evenly over its order (a sampling operator): those at the whole parts of 0, 1, ... times size / n."""
    held = numbered(rows, [by], order, "__i", "__size")
    step = F.greatest(F.col("__size") / n, F.lit(1.0))
    near = F.ceil(F.col("__i") / step)
    # The place that falls on a row is that of the step next to it, if any; neighbours are tried for the rounding of steps.
    hit = F.exists(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < n) & (F.floor(k * step) == F.col("__i")))
    return held.where(hit).drop("__i", "__size")


def stratified_sample(rows: DataFrame, stratum: str, text: str, n: int, seed: str = "") -> DataFrame:
    """Up to `n` rows a stratum without repeated texts, with `held_out` for a fifth by hash (a sampling operator)."""
    key = F.sha1(F.concat(F.lit(seed), F.col(text)).cast("binary"))
    once = rows.withColumn("key", key).dropDuplicates([stratum, "key"])
    w = Window.partitionBy(stratum).orderBy("key")
    picked = once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")
    return picked.withColumn("held_out", F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") % 5 == 0)


def agreement(a: DataFrame, b: DataFrame, least: float = 0.90, most: float = 0.15) -> DataFrame:
    """(n, agree, mean_abs_diff, passed): two readings (key, p) of the same questions."""
    both = a.select("key", F.col("p").alias("x")).join(b.select("key", F.col("p").alias("y")), "key")
    told = both.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("x") >= 0.5) == (F.col("y") >= 0.5)).cast("double")).alias("agree"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"))
    return told.select("n", F.round("agree", 6).alias("agree"), F.round("mean_abs_diff", 6).alias("mean_abs_diff"), ((F.col("agree") >= least) & (F.col("mean_abs_diff") <= most)).alias("passed"))


def unscored(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs (query_id, chunk_id) that a score cache lacks; what a resumed run still has to ask."""
    return pairs.join(cache.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def is_test(path: Column) -> Column:
    """Whether a path has a test word among its parts."""
    return F.arrays_overlap(F.split(F.lower(path), r"[ _/.]"), F.array(F.lit("test"), F.lit("tests"), F.lit("testing")))


def exact_line(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """(n, line1): how often the top line holds a span that the answer rests on.

    `answers` (query_id, line): the top lines of questions whose answer is in
    the pool; `spans` (query_id, span). White space counts as one space.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))
    asked = answers.where("line is not null").select("query_id", plain(F.col("line")).alias("line"))
    held = asked.join(spans.select("query_id", plain(F.col("span")).alias("span")).where("span <> ''"), "query_id", "left")
    told = held.groupBy("query_id").agg(F.coalesce(F.bool_or(F.contains("line", "span")), F.lit(False)).alias("hit"))
    return told.agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias("line1"))


def bag(text: str | None, features: int) -> dict[int, float]:
    """The words and word pairs of a text: 1 + log of each one's count, in hashed buckets."""
    ws = re.findall(r"\w+", (text or "").casefold())
    held: dict[int, float] = {}
    for g, n in Counter(ws + [f"{x}_{y}" for x, y in zip(ws, ws[1:])]).items():
        at = zlib.crc32(g.encode()) % features
        held[at] = held.get(at, 0.0) + 1 + math.log(n)
    return held


def bag_of_words(text: Column, features: int = 1 << 18) -> Column:
    """A sparse vector of the words and word pairs of `text`: 1 + log of each one's count, in hashed buckets."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    return F.udf(lambda t: SparseVector(features, bag(t, features)), VectorUDT())(text)


def leak_probe(rows: DataFrame, text: str, label: str, group: str, folds: int = 5, features: int = 1 << 18) -> DataFrame:
    """(fold, auc): how well words and word pairs alone tell the labels, on groups never seen in training.

    A logistic regression run until it converges, its loss summed over the
    rows and its weights (not the intercept) held down by half their square;
    what is ranked is its decision value. A fold is the hash of the group; one
    that lacks a label, in itself or in the rest, has no row.
    """
    held = rows.select(F.pmod(F.xxhash64(group), F.lit(folds)).cast("int").alias("fold"), (F.col(label) > 0).alias("positive"), F.col(text).alias("text"))
    made = logistic.blocks(held, lambda t: bag(t, features))
    return auc(logistic.by_fold(made, folds, features), "score", "positive", ["fold"])
