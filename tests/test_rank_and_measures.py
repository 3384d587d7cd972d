import random
import re

import pytest
from pyspark.sql import functions as F

from passagework.operators import bm25, evaluation, facts, index, rank
from passagework.operators.evaluation import touched_lines


def pool(spark, n, first):
    rows = [(0, "find it", i, i, first, "s", True, f"p{i}", "h", f"line {i}\n\nmore") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "query_id bigint, question string, chunk_id bigint, seq int, first int, source string, public boolean, path string, heading_path string, text string")


def numbers():
    """A reader that favours passages with small numbers in their text; made here so that it is sent by value."""

    def by_number(state, question, n):
        import re

        return [1 / int(x) for x in re.findall(r"\| line (\d+)", state)][:n]

    return by_number


def test_two_heats_take_eight_and_seven(spark):
    got = {r.chunk_id: r.score for r in rank.PassRanker("n", numbers()).score(pool(spark, 30, 30)).collect()}
    assert set(got) == set(range(1, 9)) | set(range(16, 23))
    wide = {r.chunk_id for r in rank.PassRanker("n", numbers()).score(pool(spark, 24, 15)).collect()}
    assert wide == set(range(1, 9)) | set(range(16, 23))
    assert rank.PassRanker("n", numbers()).score(pool(spark, 15, 9)).count() == 15


def test_states_are_numbered_and_cut(spark):
    from pyspark.sql import functions as F

    rows = pool(spark, 5, 5).withColumn("heat", F.lit(0))
    one = rank.render(rows).head()
    assert one.state.startswith("P01 [p1 > h]\nL000| line 1\nL001| more\n\nP02 [p2 > h]\nL002| line 2") and list(one.chunks) == [1, 2, 3, 4, 5] and list(one.lines) == [2] * 5
    assert list(rank.render(rows, 80).head().chunks) == [1, 2]
    assert rank.line_owner([2, 2], 3) == 1 and rank.line_owner([2], 5) is None


def test_answers_and_batches():
    assert rank.shaped_answer("noul", {"true": 0.71239, "false": 0.28761}) == {"noul": 0.7124, "confidence": 0.7124}
    assert rank.shaped_answer("choice", {"a": 0.2, "b": 0.8})["choice"] == "b"
    assert rank.shaped_answer("score", {"1": 0.5, "3": 0.5})["score"] == 2.0
    assert list(rank.token_batches([5, 5, 9, 30], 20)) == [[0, 1], [2], [3]]
    assert set(rank.pass_questions("q", ["P01"], ["L000"] * 600)) == {"where_passage", "exists"}
    assert rank.ranker_tag("/x/runs/v4/") == "v4" and rank.caveat(0.1, 0.2) and rank.caveat(0.3, 0.2) is None
    with pytest.raises(ValueError):
        rank.make_ranker("nope")


def test_planned_pairs_equal_the_sequential_order(spark):
    r = random.Random(1)
    n, rows = 60, []
    for a in range(n):
        for k, b in enumerate(r.sample([x for x in range(n) if x != a], 12)):
            rows.append((a, b, k))
    planned, want = set(), set()
    for a in range(n):
        got = 0
        for _, b, _ in sorted((x for x in rows if x[0] == a), key=lambda x: x[2]):
            if frozenset((a, b)) not in planned and got < 5:
                planned.add(frozenset((a, b)))
                want.add((a, b))
                got += 1
    df = spark.createDataFrame(rows, "a bigint, b bigint, rank int")
    assert {(x.a, x.b) for x in facts.planned_pairs(df, most=5).collect()} == want


def brute_bm25(docs, query, weight):
    """Scores by the textbook over two columns of words."""
    import math

    toks = {i: (re.findall(r"[a-z]+", h), re.findall(r"[a-z]+", b)) for i, (h, b) in docs.items()}
    n, avg = len(docs), sum(len(h) + len(b) for h, b in toks.values()) / len(docs)
    out = {}
    for phrase in query:
        p = phrase.split()
        count = lambda ws, p=p: sum(ws[i : i + len(p)] == p for i in range(len(ws)))
        f = {i: weight * count(h) + count(b) for i, (h, b) in toks.items()}
        df = sum(v > 0 for v in f.values())
        idf = math.log((n - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, v in f.items():
            if v:
                size = len(toks[i][0]) + len(toks[i][1])
                out[i] = out.get(i, 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * size / avg))
    return out


def test_bm25_equals_the_formula(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    words = ["night", "backup", "row", "lost", "a", "job"]
    docs = {i: (" ".join(r.choices(words, k=3)), " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(25)}
    df = spark.createDataFrame([(i, h, b, 1) for i, (h, b) in docs.items()] + [], "id bigint, head string, body string, term int")
    ix = index.build(df, "id", F.col("head"), F.col("body"))
    asked = spark.createDataFrame([(1, "Night_backup job a", None), (2, None, None), (3, "zzz", None)], "query_id bigint, text string, x string")
    got = {x.chunk_id: x.score for x in bm25.scores(ix, asked, head_weight=2.0).collect()}
    want = brute_bm25(docs, ["night backup", "job"], 2.0)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-8) for i in want)
    paired = {x.chunk_id for x in bm25.scores(ix, asked, phrases=True).collect()}
    assert paired >= set(got)
    empty = index.build(df.limit(0), "id", F.col("head"), F.col("body"))
    assert bm25.search(empty, asked, 5).count() == 0


def test_patches():
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3,3 +3,3 @@ def f\n keep\n-old\n+new\n keep\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+a\n"
    # The line that goes, and the lines on both sides of the one that comes after it.
    assert touched_lines(diff) == [("x.py", 4), ("x.py", 5)] and touched_lines(None) == []
    assert touched_lines("--- a/y\n+++ b/y\n@@ -5,2 +5,3 @@\n a\n+b\n c\n") == [("y", 5), ("y", 6)]
    assert touched_lines("--- a/y\n+++ b/y\n@@ -1,1 +1,2 @@\n+b\n c\n") == [("y", 1)]


def test_bench_rows_of_both_shapes(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"query": "q1", "answer": "s:a/b.md:7"}\n{"question": "q2", "source": "s", "path": "c", "start_line": 1, "end_line": 4}\n')
    rows = [tuple(r) for r in evaluation.bench_rows(spark, str(tmp_path / "b.jsonl")).orderBy("question").collect()]
    assert rows == [("q1", "s", "a/b.md", 7, 7), ("q2", "s", "c", 1, 4)]


def test_beir_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "1", "text": "q"}\n{"_id": "2", "text": "r"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n1\td1\t2\n2\td1\t0\n")
    corpus, queries, qrels = evaluation.beir(spark, str(tmp_path))
    assert [r.query_id for r in queries.collect()] == ["1"] and qrels.head().gain == 2 and corpus.count() == 1


def test_paired_bootstrap_is_repeatable(spark):
    a = spark.createDataFrame([(i, 0.5) for i in range(20)], "query_id bigint, v double")
    b = spark.createDataFrame([(i, 0.5 + 0.1 * (i % 3 - 1)) for i in range(20)], "query_id bigint, v double")
    one, two = evaluation.paired(a, b, "v").head(), evaluation.paired(a, b, "v").head()
    assert one == two and (one.wins, one.losses, one.ties) == (6, 7, 7) and one.low <= one.mean_diff <= one.high


def test_even_sample_and_numbers(spark):
    rows = [(k, i) for k, n in (("a", 7), ("b", 3), ("c", 1000), (None, 2)) for i in range(n)]
    df = spark.createDataFrame([(k, i, "x") for k, i in rows], "repo string, t bigint, i string")
    got = {}
    for r in evaluation.even_sample(df, "repo", ["t"], 5).collect():
        got.setdefault(r.repo, []).append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0, 1, 2, 4, 5], "b": [0, 1, 2], "c": [0, 200, 400, 600, 800], None: [0, 1]}
    assert evaluation.even_sample(df.limit(0), "repo", ["t"], 5).count() == 0


def test_slots_are_filled_by_no_answer(spark):
    hits = spark.createDataFrame([(1, 100 + s, s) for s in range(1, 8)] + [(2, 5, 1)], "query_id bigint, chunk_id bigint, seq int")
    gold = spark.createDataFrame([(1, 101), (1, 103), (1, 104), (2, 5)], "query_id bigint, chunk_id bigint")
    got = {(r.query_id, r.seq): r.chunk_id for r in evaluation.swapped_slots(hits.where("seq <= 3"), hits, gold).collect()}
    assert got == {(1, 1): 105, (1, 2): 102, (1, 3): 106}


def test_one_order_for_both_arms(spark):
    import hashlib

    rows = [(q, arm, s, 10 * s) for q in range(40) for arm, n in (("pos", 6), ("neg", 5)) for s in range(1, n + 1)]
    df = spark.createDataFrame(rows, "query_id bigint, arm string, seq int, chunk_id bigint")
    for p in (0.0, 0.5, 1.0):
        got = {(r.query_id, r.arm, r.seq): (r.chunk_id, r.shuffled) for r in evaluation.arranged(df, p).collect()}
        for q in range(40):
            h = int(hashlib.sha1(f"{q}\torder".encode()).hexdigest()[:8], 16)
            moved = p > 0 and h % 10_000 < p * 10_000
            places = list(range(6))
            if moved:
                random.Random(h).shuffle(places)
            for arm, n in (("pos", 6), ("neg", 5)):
                want = [10 * (i + 1) for i in places if i < n]
                assert [got[q, arm, k + 1] for k in range(n)] == [(c, moved) for c in want]
    salted = spark.range(30).select(evaluation.hash_pick(F.col("id").cast("string"), 7, "s").alias("n")).collect()
    assert [r.n for r in salted] == [int(hashlib.sha1(f"{i}\ts".encode()).hexdigest()[:8], 16) % 7 for i in range(30)]


def test_calibration_asks_outside_the_domain_too(spark):
    rows = [("A", "A", 0.9, True), ("A", "B", 0.9, True), ("A", "A", 0.6, False), ("A", "A", 0.95, False), ("B", "B", 0.5, False)]
    df = spark.createDataFrame(rows, "said string, gold string, p double, far boolean")
    curve = evaluation.calibration(df, "said", "gold", "p", F.col("far"))
    at = {(r["class"], r.threshold): r for r in curve.collect()}
    assert len(at) == 40 and (at["A", 0.9].kept, at["A", 0.9].precision, at["A", 0.9].ood_kept, at["A", 0.9].ood_precision) == (3, 0.667, 2, 0.5)
    assert {r["class"]: r.tau for r in evaluation.lowest_threshold(curve, 0.5, 0.4).collect()} == {"A": 0.0, "B": None}
    assert {r["class"]: r.tau for r in evaluation.lowest_threshold(curve, 0.7, 0.4).collect()} == {"A": None, "B": None}
    points = evaluation.threshold_points(evaluation.threshold_curve(df.withColumn("ok", F.col("said") == F.col("gold")), "p", "ok")).head()
    assert (points.balanced_point, points.quiet_point) == (0.95, 0.5)


def test_two_steps_give_what_full_scores_give(spark, monkeypatch):
    monkeypatch.setattr(bm25, "ROWS_AT_ONCE", 0)
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, k=2)), " ".join(["the", "of"][: r.randint(0, 2)] + r.choices(words, weights=[60 // (k + 1) for k in range(60)], k=r.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(docs, "id bigint, head string, body string")
    ix = index.build(df, "id", F.col("head"), F.col("body")).stored()
    asked = spark.createDataFrame([(1, "the w0 w59"), (2, "the of"), (3, "w0 w1 w2 w58_w3"), (4, "nothing here"), (5, None), (6, "of w40 w41 w42 w43 w0 w1")], "query_id bigint, text string")
    some = df.where("id % 3 = 0").select(F.col("id").alias("chunk_id"))
    row = lambda x: (x.query_id, x.chunk_id, x.bm25_rank, round(x.score, 7))
    every = bm25.scores(ix, asked).cache()
    for k, allowed in ((5, None), (40, some.crossJoin(asked.where("query_id <> 6").select("query_id")))):
        held = every if allowed is None else every.join(allowed, allowed.columns, "left_semi")
        assert {row(x) for x in bm25.search(ix, asked, k, allowed).collect()} == {row(x) for x in bm25.top(held, k).collect()}
    depth = spark.createDataFrame([(1, 2), (3, 4)], "query_id bigint, k int")
    assert {x.query_id: x.n for x in bm25.search(ix, asked, depth).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 2, 3: 4}


def test_batch_judge_counts_what_it_was_not_told(spark):
    def ask(kind, items):
        if any("bomb" in str(x) for x in items):
            raise TimeoutError
        if kind == "same_thing":
            return [0.9 if a[0] == b[0] else 0.1 for a, b in items]
        return [None if "secret" in x else {"Rule": 0.75, "Other": 0.25} for x in items]

    judge = facts.BatchJudge("calls", ask, spark, window=1)
    rows = spark.createDataFrame([("a must",), ("a must",), ("secret",), ("bomb",)], "passage string")
    got = {(r.passage, r.category): r.p for r in judge.categories(rows).collect()}
    assert len(got) == 7 and got["a must", "Rule"] == 0.75 and got["a must", "Finding"] == 0.0
    assert (judge.refused.value, judge.failed.value) == (1, 1)
    pairs = spark.createDataFrame([("x y", "x z"), ("x", "q")], "passage string, other string")
    assert {(r.other, r.p) for r in judge.same(pairs).collect()} == {("x z", 0.9), ("q", 0.1)}
    assert judge.query_categories(rows.limit(0).withColumnRenamed("passage", "question")).count() == 0


def test_relations_are_asked(spark):
    states = spark.createDataFrame([(1, "why", "s", ["P1", "P2"], [(0, 1), (1, 7)]), (2, None, "s", ["P1"], [])], "query_id bigint, question string, state string, passages array<string>, pairs array<struct<a:int,b:int>>")
    got = [tuple(r) for r in rank.asked_relations(states, lambda state, asked: {k: {"rule it follows": 1.0} for k in asked}).collect()]
    assert got == [(1, "P1", "P2", "rule it follows", 1.0)]


def test_plans_are_those_of_the_loop(spark):
    r = random.Random(12)
    rows = [(a, b, k) for a in range(14) for k, b in enumerate(r.sample([x for x in range(14) if x != a], 6))]
    want, sought = set(), set()
    for a in range(14):
        mine = [b for x, b, _ in rows if x == a and frozenset((a, b)) not in sought][:2]
        sought |= {frozenset((a, b)) for b in mine}
        want |= {(a, b) for b in mine}
    df = spark.createDataFrame(rows, "a bigint, b bigint, rank int")
    assert {(x.a, x.b) for x in facts.planned_pairs(df, most=2).collect()} == want
