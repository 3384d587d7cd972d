import math
import zlib

from pyspark.sql import functions as F

from passagework.operators import evaluation


def test_auc_ranks_scores_as_they_are(spark):
    rows = [(0, 0.50001, True), (0, 0.50002, True), (0, 0.500005, False), (0, 0.50002, False), (0, -7.0, False), (None, 0.2, True), (None, 0.1, False), (2, 0.3, True)]
    got = {r.g: r.auc for r in evaluation.auc(spark.createDataFrame(rows, "g int, s double, ok boolean"), "s", "ok", ["g"]).collect()}
    assert got == {0: 0.75, None: 1.0, 2: None}


def test_a_bag_holds_words_and_pairs_by_log_count(spark):
    df = spark.createDataFrame([("Ä b ä B ä",), ("",)], "text string")
    full, empty = [r.v for r in df.select(evaluation.bag_of_words(F.col("text")).alias("v")).collect()]
    at = lambda g: zlib.crc32(g.encode()) % (1 << 18)
    want = {at("ä"): 1 + math.log(3), at("b"): 1 + math.log(2), at("ä_b"): 1 + math.log(2), at("b_ä"): 1 + math.log(2)}
    assert full.size == 1 << 18 and dict(zip(full.indices.tolist(), full.values.tolist())) == want and empty.numNonzeros() == 0


def test_the_probe_sees_single_words_in_five_folds(spark):
    rows = [(("leaky", "plain")[i % 2], 1 - i % 2, f"g{i // 2}") for i in range(80)]
    got = {r.fold: r.auc for r in evaluation.leak_probe(spark.createDataFrame(rows, "text string, label int, g string"), "text", "label", "g").collect()}
    assert got == {fold: 1.0 for fold in range(5)}
    assert evaluation.leak_probe(spark.createDataFrame(rows[::2], "text string, label int, g string"), "text", "label", "g").collect() == []


def test_exact_line(spark):
    answers = spark.createDataFrame([(1, "say  the\tgold words here"), (2, "other"), (3, "no span"), (4, None)], "query_id int, line string")
    spans = spark.createDataFrame([(1, "none"), (1, "the gold\nwords"), (2, "gold"), (2, " "), (4, "x")], "query_id int, span string")
    got = evaluation.exact_line(answers, spans).head()
    assert (got.n, got.line1) == (3, 0.333)


def test_folds_share_their_passes_and_end_where_the_gradient_is_zero(spark):
    import numpy as np

    draw = np.random.default_rng(7)
    rows = [(" ".join(f"w{k}" for k in draw.integers(0, 40, 12)) + " even" * int(draw.random() < 0.5 + 0.3 * (i % 2)), i % 2, f"g{i // 4}") for i in range(240)]
    df = spark.createDataFrame(rows, "text string, label int, g string")
    spark.sparkContext.setJobGroup("probe", "probe")
    try:
        got = {r.fold: r.auc for r in evaluation.leak_probe(df, "text", "label", "g").collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("probe")) < 80
    # The same by Newton steps on a dense table.
    folds = [r[0] for r in df.select(F.pmod(F.xxhash64("g"), F.lit(5))).collect()]
    bags = [r.v for r in df.select(evaluation.bag_of_words(F.col("text")).alias("v")).collect()]
    used = sorted({int(k) for b in bags for k in b.indices})
    x, y, folds = np.array([np.append(b.toArray()[used], 1.0) for b in bags]), np.array([r[1] for r in rows]), np.array(folds)
    held = np.append(np.ones(len(used)), 0.0)
    for fold in range(5):
        a, b, w = x[folds != fold], y[folds != fold], np.zeros(len(held))
        for _ in range(30):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(held), a.T @ (p - b) + held * w)
        s, kind = x[folds == fold] @ w, y[folds == fold] == 1
        won = np.mean((s[kind][:, None] > s[~kind]) + (s[kind][:, None] == s[~kind]) / 2)
        assert abs(got[fold] - won) < 2e-6
