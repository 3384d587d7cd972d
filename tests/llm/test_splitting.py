import random
import time

import pytest

from passagework.llm.splitting import LIMIT, OVERLAP, oversized_lines, split_files, split_texts


def make_text(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        kind = r.random()
        if kind < 0.02:
            out.append("x" * r.randint(10, 4000))
        elif kind < 0.1:
            out.append("\n\n")
        elif kind < 0.2:
            out.append("\n# Head ")
        elif kind < 0.25:
            out.append("é́ ")
        else:
            out.append(r.choice(["word ", "longer words. ", "line\n", "naïve ", "日本 "]))
    return "".join(out)


def check(text: str, rows, start_line: int = 1):
    rows = sorted(rows, key=lambda r: r.start_char)
    assert "".join(r.text[r.overlap_chars :] for r in rows) == text
    lines = text.split("\n")
    long_lines = {start_line + i for i, x in enumerate(lines) if len(x) > LIMIT}
    assert {x for r in rows for x in r.long_lines} == long_lines
    for i, r in enumerate(rows):
        assert 0 < len(r.text) <= LIMIT and text[r.start_char : r.end_char] == r.text
        assert r.start_line == start_line + text.count("\n", 0, r.start_char)
        assert r.end_line == start_line + text.count("\n", 0, r.end_char - 1)
        assert (r.overlap_chars == 0) == (i == 0)
        if i:
            assert rows[i - 1].text.endswith(r.text[: r.overlap_chars])
            assert r.overlap_chars == min(OVERLAP, len(rows[i - 1].text)) or (abs(r.overlap_chars - OVERLAP) <= OVERLAP // 2 and text[r.start_char - 1] == "\n")
            cut = r.start_char + r.overlap_chars
            if not text[cut - 1].isspace():  # a hard cut only where no white space was in reach
                # (a range may end inside a run without any that must be cut anyway)
                assert not any(c.isspace() for c in text[rows[i - 1].start_char + rows[i - 1].overlap_chars + 1 : cut]) or not any(c.isspace() for c in text[cut : cut + 2 * LIMIT - 1])


def test_round_trip_in_one_range_and_in_many(spark):
    texts = {i: make_text(i, n) for i, n in enumerate([1600, 5000, 30000, 60000, 90000])}
    texts[9] = "y" * 70000  # one line over many ranges
    df = spark.createDataFrame([(i, t, 7, "A > B", "clash") for i, t in texts.items()], "id bigint, text string, start_line int, heading_path string, __new string")
    for size in (None, 1 << 20, 24000, 7001):
        got = split_texts(df, ["id", "heading_path"], range_chars=size).collect()
        assert {r.id for r in got} == set(texts) and {r.heading_path for r in got} == {"A > B"}
        for i, t in texts.items():
            check(t, [r for r in got if r.id == i], 7)


def test_nulls_short_and_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", 1), (3, "x" * LIMIT, 1), (None, "z " * 1000, None), (4, "q" * 1501, 3)], "id bigint, text string, start_line int")
    got = split_texts(df, ["id"])
    assert {r.id for r in got.collect()} == {None, 4}
    assert {tuple(r) for r in oversized_lines(got, "id").collect()} == {(4, 3), (None, 1)}
    assert split_texts(df.limit(0), ["id"]).count() == 0


def test_lines_or_zero(spark):
    text = "a b\n" * 500 + "x" * 1501 + "\n" + "c\n" + "y" * 1600
    df = spark.createDataFrame([(1, text, 10), (2, "a b\n" * 500, 1)], "id bigint, text string, start_line int")
    got = oversized_lines(split_texts(df, ["id"]), "id")
    assert {tuple(r) for r in got.collect()} == {(1, 510), (1, 512), (2, 0)}


def test_files_by_byte_range(spark, tmp_path):
    texts = {}
    for i, n in enumerate([3000, 150000, 400000]):
        path = str(tmp_path / f"f{i}.txt")
        texts[path] = make_text(50 + i, n) + "日本語" * 5000
        open(path, "w", newline="").write(texts[path])
    (tmp_path / "empty.txt").write_text("")
    got = split_files(spark, [*texts, str(tmp_path / "empty.txt")], range_bytes=96001).collect()
    assert {r.path for r in got} == set(texts)
    for path, t in texts.items():
        check(t, [r for r in got if r.path == path])


def test_pieces_do_not_depend_on_the_ranges(spark, tmp_path):
    texts = {i: make_text(90 + i, n) for i, n in enumerate([1600, 6100, 9001, 25000, 80000])}
    texts[8], texts[9] = "line of text\n" * 4000, "\u0301" * 7000
    df = spark.createDataFrame([(i, t, 3) for i, t in texts.items()] + [(3, texts[3], 3), (3, texts[4], 3)], "id bigint, text string, start_line int")
    told = lambda rows, k: sorted((r[k], r.start_char, r.end_char, r.overlap_chars, r.start_line, tuple(r.long_lines)) for r in rows)
    plain = told(split_texts(df, ["id"]).collect(), "id")
    for size in (997, 6000, 1 << 20):
        assert told(split_texts(df, ["id"], range_chars=size).collect(), "id") == plain
    path = tmp_path / "long.txt"
    path.write_text(texts[4], newline="")
    files = [told(split_files(spark, [str(path)], range_bytes=n).collect(), "path") for n in (5003, 65536, 1 << 20)]
    assert files[0] == files[1] == files[2]
    assert [x[1:4] for x in files[0]] == [x[1:4] for x in told(split_texts(df.where("id = 4"), ["id"]).collect(), "id")]


def test_a_giant_text_costs_in_proportion(spark, tmp_path):
    took = []
    for mb in (4, 4, 16):
        path = tmp_path / f"{mb}.txt"
        path.write_text("some words of a long text, and more of them.\n" * (mb * 1024 * 1024 // 45))
        began = time.time()
        rows = split_files(spark, [str(path)], range_bytes=1 << 18).selectExpr("sum(length(text) - overlap_chars) n", "max(length(text)) m").head()
        took.append(time.time() - began)
        assert rows.n == path.stat().st_size and rows.m <= LIMIT
    assert took[2] < 8 * max(took[1], 1)


def test_bad_sizes(spark):
    df = spark.createDataFrame([(1, "x")], "id bigint, text string")
    with pytest.raises(ValueError):
        split_texts(df, ["id"], start_line=None, limit=100, overlap=50)
    with pytest.raises(ValueError):
        split_files(spark, ["/nowhere"], range_bytes=1)
