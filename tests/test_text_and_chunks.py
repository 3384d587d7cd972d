import re

import pytest
from pyspark.sql import functions as F

from passagework.functions import text
from passagework.functions.text import glob_regex
from passagework.operators import chunking


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).head().y


def test_names(spark):
    body = "Call `get_rows()` or `x y`, see fooBar, FooBar, SHOP-12, a.b.c, acme/shop#7, \"txn.scored\", plain `ab`, _x, snake_case_name."
    assert set(one(spark, body, text.names_in)) == {"get_rows", "foobar", "shop-12", "a.b.c", "acme/shop#7", "txn.scored", "snake_case_name"}
    assert one(spark, None, text.names_in) == [] and one(spark, "", text.names_in) == []


def test_folding_and_terms(spark):
    assert one(spark, "Hợp Đồng_CAFÉ é ß ά й", text.terms) == ["hop", "đong", "cafe", "e", "ß", "ά", "й"]
    assert one(spark, "é̂x", text.fold) == "ex"
    assert one(spark, None, text.terms) == []


@pytest.mark.parametrize("value,want", [("Hợp đồng", True), ("ả", True), ("résumé naïve", False), ("", False), (None, False)])
def test_vietnamese(spark, value, want):
    assert one(spark, value, text.is_vietnamese) is want


def test_links_and_paths(spark):
    body = 'a [x](../b.md#Top "t") [y](c/./d.md) [z](https://h/p#q) [m](mailto:a@b) [h](#here) ![i](i.png)'
    got = [tuple(r) for r in one(spark, body, lambda c: text.link_targets(c, F.lit("docs/sub/a.md")))]
    assert got == [("docs/b.md", "Top"), ("docs/sub/c/d.md", ""), ("https://h/p#q", ""), ("docs/sub/a.md", "here"), ("docs/sub/i.png", "")]
    assert one(spark, "a/../../x//./y", text.normal_path) == "../x/y"


def test_small_functions(spark):
    assert one(spark, "  Größe & Maß (v2)_x ", text.slug) == "größe-maß-v2_x"
    assert one(spark, "<!-- defines: A b A -->\nx", text.defined_names) == ["A", "b"]
    assert one(spark, "on 2026-01-01 and 2026-01-03, 2026-13-01", text.date_facts) == ["2026-01-01 is 2 days before 2026-01-03"]
    assert tuple(one(spark, "wiki:Ops/a:b.md:4-9", text.coordinate)) == ("wiki", "Ops/a:b.md", 4, 9)
    assert tuple(one(spark, "wiki:a.md:4", text.coordinate)) == ("wiki", "a.md", 4, 4)
    assert tuple(one(spark, "wiki:a.md", text.coordinate)) == ("wiki", "a.md", None, None)
    sizes = {1023: "1023 B", 1536: "1.5 KB", 1280: "1.2 KB", 5 << 20: "5.0 MB"}
    assert {n: one(spark, str(n), lambda c: text.size_text(c.cast("bigint"))) for n in sizes} == sizes
    for ms, want in ((None, "default"), ("-1", "forever"), ("604800000", "7 days"), ("5400000", "1.5 hours")):
        assert one(spark, ms, text.retention_text) == want


def test_decoding(spark):
    df = spark.createDataFrame([(b"a\r\nb\rc",), (b"a\0b",), (b"\xff",)], "x binary")
    rows = df.select(text.decoded(F.col("x")).alias("t"), text.decoded(F.col("x"), True).alias("s")).collect()
    assert [r.t for r in rows] == ["a\nb\rc", None, "�"] and rows[0].s == "a\nb\nc"


def test_glob():
    assert re.match(glob_regex("Ops/*"), "Ops/a/b") and not re.match(glob_regex("Ops/?"), "Ops/ab")
    assert re.match(glob_regex("[ab].x"), "b.x") and re.match(glob_regex("[!a]x"), "bx") and re.match(glob_regex("a+b"), "a+b")


def chunks(spark, body, lang):
    df = spark.createDataFrame([(1, lang, body)], "file_id bigint, lang string, text string")
    got = chunking.with_names(chunking.chunks_of(df)).orderBy("seq").collect()
    lines = body.split("\n")
    for c in got:
        assert c.text == "\n".join(lines[c.start_line - 1 : c.end_line])
    return got


def test_markdown_sections_and_fences(spark):
    body = "intro\n\n# A\ntext\n```\n# not a heading\n```\n## B\n\n### C\nbody [x](y.md)\n# A\nagain"
    got = chunks(spark, body, "markdown")
    assert [(c.heading_path, c.start_line, c.end_line) for c in got] == [("", 1, 1), ("A", 3, 7), ("A > B > C", 10, 11), ("A", 12, 13)]
    assert got[2].parent_seq == 1 and got[2].anchor == "c"


def test_python_by_definitions(spark):
    method = "    def {}(self):\n" + "        value_name = 1\n" * 40
    body = "import os\n\n@decorate\ndef alone():\n    return os\n\nclass Big:\n    kind = 1\n\n" + method.format("one") + "\n" + method.format("two") + "\nrun_it = alone()\n"
    got = chunks(spark, body, "python")
    assert [(c.kind, c.heading_path) for c in got] == [("function", "alone"), ("class", "Big"), ("function", "Big.one"), ("function", "Big.two"), ("module", "(module)"), ("module", "(module)")]
    assert got[0].start_line == 3 and got[0].defines == ["alone"] and "os" not in got[0].mentions and got[2].parent_seq == 1
    assert "value_name" in got[2].mentions and "self" not in got[2].mentions
    assert [c.kind for c in chunks(spark, "def broken(:\n  x", "python")] == ["block"]


def test_clauses_are_cut_and_no_line_is_lost(spark):
    body = "# Luật\n" + "\n".join(f"{i}. điều khoản số {i} " + "x" * 100 for i in range(1, 31))
    got = chunks(spark, body, "markdown")
    assert len(got) > 1 and max(len(c.text) for c in got) < 1700
    assert [n for c in got for n in range(c.start_line, c.end_line + 1)] == list(range(1, 32))


def test_null_and_blank_files(spark):
    df = spark.createDataFrame([(1, "markdown", None), (2, None, "  \n"), (3, None, "x")], "file_id bigint, lang string, text string")
    assert [r.file_id for r in chunking.chunks_of(df).collect()] == [3]


class Node:
    """A syntax node as the grammar pack has it."""

    def __init__(self, kind, rows, name=None, kids=(), body=None):
        self.type, self.start_point, self.end_point = kind, (rows[0], 0), (rows[1], 0)
        self.named_children = [*kids, *([body] if body else [])]
        self.fields = {"body": body, "name": name}
        self.prev_named_sibling = None
        for a, b in zip(self.named_children, self.named_children[1:]):
            b.prev_named_sibling = a
        self.text = (name or "").encode()

    def child_by_field_name(self, field):
        value = self.fields.get(field)
        return Named(value) if isinstance(value, str) else value


class Named:
    def __init__(self, name):
        self.text = name.encode()


def test_definitions_by_a_grammar():
    body = "// about f\nfunction f() {\n}\nlet x = 1\n"
    root = Node("program", (0, 4), kids=[Node("comment", (0, 0)), Node("function_declaration", (1, 2), "f"), Node("expression_statement", (3, 3))])
    parser = type("P", (), {"parse": lambda self, data: type("T", (), {"root_node": root})()})()
    got = chunking.cut_by_grammar(body, "javascript", parser)
    assert [(p.kind, p.heading, p.start, p.end, p.defines) for p in got] == [("function", "f", 1, 3, "f"), ("module", "(module)", 4, 4, "")]


def test_members_and_identifiers_by_a_grammar():
    body = "\n".join(["class Big {", "  // pad " + "x" * 800, "  one() {", "    callMe", "  }", "  two() {", "    " + "y" * 800, "  }", "}"])
    call = Node("identifier", (3, 3), "callMe")
    call.text = b"callMe"
    one, two = Node("method_definition", (2, 4), "one", kids=[call]), Node("method_definition", (5, 7), "two")
    big = Node("class_declaration", (0, 8), "Big", body=Node("class_body", (0, 8), kids=[one, two]))
    root = Node("program", (0, 8), kids=[big])
    parser = type("P", (), {"parse": lambda self, data: type("T", (), {"root_node": root})()})()
    got = chunking.cut_by_grammar(body, "javascript", parser)
    assert [(p.kind, p.heading, p.start, p.end, p.parent, p.mentions) for p in got] == [("class", "Big", 1, 2, None, []), ("function", "Big.one", 3, 5, 0, ["callme"]), ("function", "Big.two", 6, 8, 0, []), ("module", "(module)", 9, 9, None, [])]
    small = Node("program", (0, 4), kids=[Node("class_declaration", (0, 2), "C", body=Node("class_body", (0, 2), kids=[Node("method_definition", (1, 1), "m")]))])
    parser = type("P", (), {"parse": lambda self, data: type("T", (), {"root_node": small})()})()
    assert [(p.heading, p.start, p.end) for p in chunking.cut_by_grammar("class C {\n m(){}\n}\n", "javascript", parser)] == [("C", 1, 3)]


def test_definitions_that_share_lines():
    of = lambda body: [(p.kind, p.heading, p.start, p.end) for p in chunking.cut(body, "python")]
    assert of("def a(): pass\nx = 1; y = 2\nclass C:\n    def m(self): pass\n") == [("function", "a", 1, 1), ("class", "C", 3, 4), ("module", "(module)", 2, 2)]
    assert of("if x:\n    def hidden(): pass\n") == [("module", "(module)", 1, 2)]
    assert of("def outer():\n    def inner(): pass\n    return inner\n") == [("function", "outer", 1, 3)]
