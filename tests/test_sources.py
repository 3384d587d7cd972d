"""Renderers and connectors against small fakes."""

import datetime
import io
import sqlite3
import urllib.error

import pytest

from passagework.operators import links
from passagework.sources import confluence, drive, files, github, jira, kafka, notion, objects, sqlcatalog
from passagework.sources.markdown import segment, table, tidy
from passagework.sources.remote import Client, Doc, Entry, RemoteError, built_in, clean_meta, make_source

PAGE = """<h1>Deploy</h1><p>Run <code>make all</code>, see <ac:link><ri:page ri:content-title="Rules" /></ac:link> &amp; <a href="https://x.atlassian.net/wiki/spaces/S/pages/2/T">two</a>.</p>
<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[SELECT 1;
# not a heading]]></ac:plain-text-body></ac:structured-macro>
<ac:structured-macro ac:name="toc" /><ac:structured-macro ac:name="include"><ac:parameter ac:name=""><ac:link><ri:page ri:content-title="Rules"/></ac:link></ac:parameter></ac:structured-macro>
<ac:structured-macro ac:name="lucidchart"><ac:parameter ac:name="title">Flow</ac:parameter><ac:parameter ac:name="url">https://l/1</ac:parameter></ac:structured-macro>
<ac:structured-macro ac:name="info"><ac:rich-text-body><p>Mind it</p></ac:rich-text-body></ac:structured-macro>
<table><tbody><tr><th>Owner</th><td>Ann</td></tr><tr><th>Team</th><td>Core</td></tr></tbody></table>
<table><tr><th>A</th><th>B</th></tr><tr><td><p>1</p></td><td><ul><li>x</li><li>y</li><li>z</li><li>w</li></ul></td></tr></table>
<ul><li>one<ul><li>two</li></ul></li></ul><ol><li>first</li></ol>
<ac:task-list><ac:task><ac:task-status>complete</ac:task-status><ac:task-body>done it</ac:task-body></ac:task></ac:task-list>
<p><ac:structured-macro ac:name="jira"><ac:parameter ac:name="key">SHOP-9</ac:parameter></ac:structured-macro> <ac:image ac:alt="pic"><ri:attachment ri:filename="a b.png" /></ac:image> <ac:link><ri:user ri:account-id="u1"/></ac:link></p>"""


def test_confluence_page():
    page = confluence.Page("https://x.atlassian.net", "S", "1", "Home/Deploy.md", {"1": "Home/Deploy.md", "2": "Home/Rules.md"}, {"Rules": "2"}, {"u1": "Ann"})
    got = page.markdown("Deploy guide", PAGE)
    for part in (
        "# Deploy guide",
        "\n## Deploy\n",
        "Run `make all`, see [Rules](Rules.md) & [two](Rules.md).",
        "```sql\nSELECT 1;\n# not a heading\n```",
        "Included from [Rules](Rules.md)",
        "![Lucidchart diagram: Flow](https://l/1)",
        "**Info:**\nMind it",
        "- **Owner:** Ann\n- **Team:** Core",
        "**B:**\n- x\n- y",
        "- one\n  - two",
        "1. first",
        "- [x] done it",
        "SHOP-9 ![pic](https://x.atlassian.net/wiki/download/attachments/1/a%20b.png) @Ann",
    ):
        assert part in got, part
    assert "toc" not in got
    pages = [{"id": "1", "title": "A/B"}, {"id": "2", "title": "a-b"}, {"id": "3", "title": "C", "parentId": "1"}, {"id": "4", "title": "D", "parentId": "99"}]
    assert confluence.page_paths(pages) == {"1": "A-B.md", "2": "a-b-2.md", "3": "A-B/C.md", "4": "D.md"}
    assert confluence.origin("https://x.atlassian.net/wiki/spaces/S/overview") == "https://x.atlassian.net/wiki/spaces/S"
    assert confluence.locate("https://x.atlassian.net/wiki/spaces/S/pages/12/T#A-b") == ("12", "A-b") == confluence.locate("https://x.atlassian.net/wiki/x?pageId=12#A-b")


class FakeApi:
    """Answers by path prefix; a callable gets the parameters."""

    def __init__(self, answers):
        self.answers, self.asked = answers, []

    def get(self, path, **params):
        self.asked.append((path, params))
        found = next(v for k, v in sorted(self.answers.items(), key=lambda x: -len(x[0])) if path.startswith(k))
        return found(params) if callable(found) else found

    def post(self, path, body):
        return self.get(path, **body)

    def raw(self, path, **params):
        return self.get(path, **params)


def test_confluence_remote():
    body = {"storage": {"value": "<p>Hi</p>"}}
    api = FakeApi({
        "/wiki/api/v2/spaces/7/pages": {"results": [{"id": "1", "title": "Home", "version": {"number": 3}, "_links": {"webui": "/w"}}], "_links": {}},
        "/wiki/api/v2/spaces": {"results": [{"id": "7"}]},
        "/wiki/api/v2/pages/1/labels": {"results": [{"name": "l"}]},
        "/wiki/api/v2/pages": {"results": [{"id": "1", "title": "Home", "body": body, "authorId": "u", "version": {}}]},
        "/wiki/rest/api/user/bulk": {"results": [{"accountId": "u", "displayName": "Ann"}]},
    })
    r = confluence.Remote("https://x.atlassian.net/wiki/spaces/S", api)
    assert r.listing()["1"] == Entry("3", "Home.md", "https://x.atlassian.net/wiki/w")
    (item, doc), = r.fetch(["1"])
    assert doc.text == "# Home\n\nHi\n" and doc.meta["author"] == "Ann" and doc.meta["labels"] == ["l"]
    with pytest.raises(RemoteError):
        confluence.Remote("https://x.atlassian.net/wiki/spaces/S", FakeApi({"/": {"results": []}})).listing()


def text_node(text, *marks):
    return {"type": "text", "text": text, "marks": [{"type": m} if isinstance(m, str) else m for m in marks]}


def test_jira_issue():
    adf = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 1}, "content": [text_node("Why")]},
        {"type": "paragraph", "content": [text_node("run", "code"), text_node(" it", "strong"), {"type": "hardBreak"}, text_node("docs", {"type": "link", "attrs": {"href": "http://d e"}}), {"type": "mention", "attrs": {"text": "@Bo"}}]},
        {"type": "orderedList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [text_node("a")]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [text_node("b")]}]}]}]}]},
        {"type": "taskList", "content": [{"type": "taskItem", "attrs": {"state": "DONE"}, "content": [text_node("t")]}]},
        {"type": "codeBlock", "attrs": {"language": "sql"}, "content": [text_node("SELECT 1")]},
        {"type": "table", "content": [{"content": [{"content": [{"type": "paragraph", "content": [text_node("h|1")]}]}]}, {"content": [{"content": [{"type": "paragraph", "content": [text_node("v")]}]}]}]},
        {"type": "paragraph", "content": [{"type": "date", "attrs": {"timestamp": "1767225600000"}}, {"type": "status", "attrs": {"text": "OK"}}]},
        {"type": "mediaSingle", "content": [{"type": "media", "attrs": {"alt": "m"}}]},
    ]}
    issue = {"key": "SHOP-1", "fields": {"summary": "S", "description": adf, "issuetype": {"name": "Bug"}, "status": {"name": "Done"}, "resolution": {"name": "Fixed"}, "assignee": {"displayName": "Bo"}, "created": "2026-01-02T03:04:05", "updated": "2026-01-03T", "labels": ["l"], "issuelinks": [{"type": {"outward": "blocks", "inward": "is blocked by"}, "inwardIssue": {"key": "SHOP-2", "fields": {"summary": "o"}}}], "comment": {"comments": [{"id": "1"}], "total": 2}}}
    comments = [{"id": "5", "created": "2026-01-02T03:04:05", "author": {"displayName": "Cy"}, "body": {"type": "doc", "content": [{"type": "paragraph", "content": [text_node("note")]}]}}]
    doc = jira.issue_doc("https://x.atlassian.net", issue, comments)
    for part in ("# SHOP-1 S\n<!-- defines: SHOP-1 -->", "Bug · Done (Fixed) · assignee Bo · created 2026-01-02 · updated 2026-01-03", "- is blocked by SHOP-2 o", "### Why", "`run`** it**\n[docs](http://d%20e)@Bo", "1. a\n   - b", "- [x] t", "```sql\nSELECT 1\n```", "| h\\|1 |", "2026-01-01[OK]", "[image: m]", "## Comment 2026-01-02 03:04 Cy\n\nnote"):
        assert part in doc.text, part
    assert doc.anchors == {"comment-2026-01-02-0304-cy": "https://x.atlassian.net/browse/SHOP-1?focusedCommentId=5"}
    assert clean_meta(doc.meta)["status"] == ["Done"] and "parent" not in clean_meta(doc.meta)
    assert jira.origin("https://x.atlassian.net/browse/SHOP", "type = Bug").endswith("%28project%20%3D%20SHOP%29%20AND%20%28type%20%3D%20Bug%29")
    assert jira.locate("https://x.atlassian.net/browse/SHOP-1?focusedCommentId=5") == ("SHOP-1", "focusedCommentId=5")
    pages = iter([{"issues": [{"key": "SHOP-1", "fields": {"updated": "u1"}}], "isLast": False, "nextPageToken": "t"}, {"issues": [{"key": "SHOP-2", "fields": {"updated": "u2"}}], "isLast": True}])
    r = jira.Remote(jira.origin("https://x.atlassian.net/projects/SHOP"), FakeApi({"/rest/api/3/search/jql": lambda p: next(pages), "/rest/api/3/issue": {"comments": [{"id": "2"}]}}))
    assert r.name == "jira-SHOP" and list(r.listing()) == ["SHOP-1", "SHOP-2"] and [c["id"] for c in r.thread(issue)] == ["1", "2"]


def test_github_item():
    item = {"number": 7, "title": "T", "state": "closed", "pull_request": {"merged_at": "x"}, "user": {"login": "ann"}, "html_url": "https://github.com/a/b/pull/7", "created_at": "2026-01-01T00:00", "updated_at": "2026-01-02", "closed_at": "2026-01-02", "labels": [{"name": "l"}], "body": "# Head\nsee #8, `#8`, a/c#8 and https://github.com/a/b/issues/8#x\n```\n#8\n```", "comments": 1}
    comment = {"created_at": "2026-01-03T01:02:03", "user": {"login": "bo"}, "body": "ok", "html_url": "c1"}
    line = {"created_at": "2026-01-02T01:02:03", "user": {"login": "cy"}, "body": "why", "path": "x.py", "line": 3, "diff_hunk": "@@\n+a"}
    review = {"submitted_at": "2026-01-04", "state": "CHANGES_REQUESTED", "body": "no", "user": {"login": "di"}}
    doc = github.item_doc("https://github.com/a/b", item, [comment], [review, {"state": "APPROVED"}], [line], {"8": "issues/8.md", "7": "pulls/7.md"})
    for part in ("# b#7 T\n<!-- defines: b#7 a/b#7 -->", "Pull request · merged · by ann", "### Head\nsee [#8](../issues/8.md), `#8`, a/c#8 and [#8](../issues/8.md)\n```\n#8\n```", "## Review 2026-01-04 di (changes requested)", "```diff\n@@\n+a\n```"):
        assert part in doc.text, part
    heads = [x for x in doc.text.split("\n") if x.startswith("## ")]
    assert [h.split()[1] for h in heads] == ["Description", "Review", "Comment", "Review"] and "on x.py:3" in heads[1]
    assert doc.meta["state"] == "merged" and github.locate("https://github.com/a/b/pull/7#x") == ("7", "x")
    r = github.Remote("https://github.com/a/b", FakeApi({"/repos/a/b/issues/7/comments": [comment], "/repos/a/b/pulls": [], "/repos/a/b/issues": [item]}))
    assert r.listing()["7"].path == "pulls/7.md" and next(iter(r.fetch(["7"])))[1].meta["item"] == "pull"


def test_sql_catalog(tmp_path):
    path = tmp_path / "shop.db"
    with sqlite3.connect(path) as con:
        con.executescript("CREATE TABLE orders(id INTEGER PRIMARY KEY, total REAL NOT NULL); CREATE TABLE items(id INTEGER, order_id INTEGER REFERENCES orders(id)); CREATE UNIQUE INDEX by_order ON items(order_id); CREATE VIEW v AS SELECT 1 AS one; INSERT INTO orders VALUES (424242, 1.5)")
    r = sqlcatalog.Remote(sqlcatalog.origin(f"sqlite:///{path}"))
    found = r.listing()
    assert set(found) == {"main.orders", "main.items", "main.v"} and r.name == "sqlite-shop"
    cards = {i: d.text for i, d in r.fetch(list(found))}
    assert "- `order_id` → [orders](orders.md) (`id`)" in cards["main.items"] and "- `by_order` on `order_id` (unique)" in cards["main.items"]
    assert "- [items](items.md) (`order_id`)" in cards["main.orders"] and "**Primary key:** `id`" in cards["main.orders"] and "424242" not in cards["main.orders"]
    assert "```sql\nCREATE VIEW v" in cards["main.v"]
    assert sqlcatalog.origin("postgres://ann:secret@h:5/db") == "postgresql://ann@h:5/db" and sqlcatalog.origin("https://x") is None


def test_kafka_cards():
    topics = [kafka.Topic("_hidden", 1), kafka.Topic("txn.scored", 3, {"retention.ms": "86400000"}, b'{"id": 7, "ok": true, "at": null}'), kafka.Topic("raw", 1, {}, b"\0x"), kafka.Topic("keyed", 1)]
    registry = FakeApi({"/subjects/keyed-value": {"version": 2, "schema": '{"fields": [{"name": "a", "type": ["null", {"type": "long", "logicalType": "date"}], "doc": "d"}]}'}, "/subjects/keyed-key": {"schema": '"string"'}, "/subjects": ["keyed-value", "keyed-key"]})
    r = kafka.Remote("kafka://b:9092", lambda brokers: topics, registry)
    found = {i: d.text for i, d in r.fetch(list(r.listing()))}
    assert set(found) == {"txn.scored", "raw", "keyed"}
    assert "3 partitions, retention 1 days" in found["txn.scored"] and "| id | integer |" in found["txn.scored"] and "| 7 |" not in found["txn.scored"]
    assert "the newest message is not JSON" in found["raw"] and "| a | long (date) (nullable) | d |" in found["keyed"] and "**Key:** AVRO `string`" in found["keyed"]
    assert kafka.avro_type({"type": "map", "values": {"type": "array", "items": "int"}}) == "map<array<int>>"
    assert kafka.schema_fields("PROTOBUF", "message  A {}")[0][2] == "message A {}"


def test_object_store(spark, tmp_path):
    assert objects.dataset_of("a/d=1/h=2/x.parquet") == ("a", ["d", "h"]) and objects.dataset_of("x.csv") == ("x.csv", []) and objects.dataset_of("a/x.txt") is None
    (tmp_path / "new.csv").write_text("k,v\n1,2\n")
    t = datetime.datetime
    listed = [("p/sales/d=1/a.csv", t(2026, 1, 1)), ("p/sales/d=2/h=1/b.csv", t(2026, 1, 2)), ("p/bad/x.parquet", t(2026, 1, 1)), ("p/n.txt", t(2026, 1, 1))]
    r = objects.Remote("s3://b/p/", (lambda b, p: listed, lambda b, k: str(tmp_path / ("new.csv" if "sales" in k else "none.parquet"))))
    found = {i: d.text for i, d in r.fetch(list(r.listing()))}
    assert "Partitioned by `d, h`" in found["sales"] and "Schema read from `p/sales/d=2/h=1/b.csv`" in found["sales"] and "| k | int64 |" in found["sales"]
    assert "(unreadable)" in found["bad"]
    df = spark.createDataFrame([(k.removeprefix("p/"), m) for k, m in listed], "key string, modified timestamp_ntz")
    got = {r.dataset: (list(r.partition_keys), r.newest, r.files) for r in objects.datasets(df).collect()}
    assert got == {"sales": (["d", "h"], "sales/d=2/h=1/b.csv", 2), "bad": ([], "bad/x.parquet", 1)}


def rich(text, **style):
    return [{"plain_text": text, "annotations": style}]


def test_notion():
    pid, sub = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    title = lambda t: {"Name": {"type": "title", "title": rich(t)}}
    pages = [
        {"object": "page", "id": pid, "properties": {**title("Top"), "Stage": {"type": "select", "select": {"name": "Done"}}, "Tags": {"type": "multi_select", "multi_select": [{"name": "a"}]}, "Due": {"type": "date", "date": {"start": "2026-01-01T00", "end": "2026-01-02"}}}, "parent": {"type": "workspace"}, "last_edited_time": "e1", "created_time": "c"},
        {"object": "page", "id": sub, "properties": title("Sub"), "parent": {"type": "page_id", "page_id": pid}, "last_edited_time": "e2"},
        {"object": "page", "id": "3", "properties": title("Gone"), "in_trash": True},
    ]
    blocks = [
        {"id": "b1", "type": "heading_1", "heading_1": {"rich_text": rich("Head")}},
        {"id": "b2", "type": "paragraph", "paragraph": {"rich_text": rich(" bold ", bold=True)}},
        {"id": "b3", "type": "numbered_list_item", "numbered_list_item": {"rich_text": rich("one")}},
        {"id": "b4", "type": "numbered_list_item", "numbered_list_item": {"rich_text": rich("two")}},
        {"id": "b5", "type": "to_do", "to_do": {"rich_text": rich("t"), "checked": True}},
        {"id": "b6", "type": "code", "code": {"rich_text": rich("x = 1"), "language": "python"}},
        {"id": sub, "type": "child_page", "child_page": {"title": "Sub"}},
        {"id": "b8", "type": "table_of_contents"},
        {"id": "b9", "type": "column_list", "has_children": True},
    ]
    api = FakeApi({"/search": lambda p: {"results": pages if p["filter"]["value"] == "page" else []}, f"/blocks/{pid}/children": {"results": blocks}, "/blocks/b9/children": {"results": [{"id": "c", "type": "quote", "quote": {"rich_text": rich("q")}}]}, f"/blocks/{sub}/children": {"results": []}})
    r = notion.Remote(notion.origin("https://www.notion.so/x-11111111111111111111111111111111"), api)
    assert {i: e.path for i, e in r.listing().items()} == {pid: "Top.md", sub: "Top/Sub.md"}
    doc = dict(r.fetch([pid]))[pid]
    for part in ("# Top\n\n- **Stage:** Done\n- **Tags:** a\n- **Due:** 2026-01-01T00 to 2026-01-02", "## Head", "**bold**", "1. one\n2. two\n- [x] t", "```python\nx = 1\n```", "[Sub](Top/Sub.md)", "> q"):
        assert part in doc.text, part
    assert doc.meta["status"] == "Done" and doc.meta["labels"] == ["a"] and doc.meta["due"] == "2026-01-01" and "head" in doc.anchors
    with pytest.raises(RemoteError, match="nothing was synced"):
        notion.Remote(notion.WEB, FakeApi({"/search": {"results": [], "request_status": {"type": "incomplete"}}})).listing()


def test_drive():
    sheet, folder = "application/vnd.google-apps.spreadsheet", drive.FOLDER
    inside = {"root": [{"id": "f1", "name": "Plans", "mimeType": folder}, {"id": "s1", "name": "Sheet", "mimeType": sheet, "version": "4"}, {"id": "x", "name": "v.mp4", "mimeType": "video/mp4"}], "f1": [{"id": "t1", "name": "N.md", "mimeType": "text/markdown", "size": "5"}, {"id": "t2222222222", "name": "n.md", "mimeType": "text/markdown", "size": "5"}]}
    api = FakeApi({"/files/s1/export": b"a,b\n1,2\n", "/files/t": b"hello\r\n", "/files": lambda p: {"files": inside[p["q"].split("'")[1]]}})
    r = drive.Remote("https://drive.google.com/drive", api)
    assert {i: e.path for i, e in r.listing().items()} == {"s1": "Sheet.md", "t1": "Plans/N.md", "t2222222222": "Plans/n-t2222222.md"}
    got = {i: d.text for i, d in r.fetch(["s1", "t1"])}
    assert got == {"s1": "# Sheet\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "t1": "# N\n\nhello\n"}


def test_http_client_is_patient(monkeypatch):
    waits, answers = [], [urllib.error.HTTPError("u", 429, "busy", {"Retry-After": "3"}, None), TimeoutError(), io.BytesIO(b'{"a": 1}')]

    def opened(request, timeout):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    monkeypatch.setattr("urllib.request.urlopen", opened)
    assert Client("http://h", wait=waits.append).get("/p", x=1) == {"a": 1} and waits == [3.0, 2.0]
    answers[:] = [urllib.error.HTTPError("u", 403, "no", {}, None)]
    with pytest.raises(RemoteError, match="403"):
        Client("http://h").get("/p?secret=1")


def test_registry_takes_addresses():
    r = built_in()
    for url, kind in (("https://x.atlassian.net/wiki/spaces/S", "confluence"), ("https://x.atlassian.net/projects/SHOP", "jira"), ("https://github.com/a/b/issues/1", "github"), ("sqlite:///a.db", "sql"), ("kafka://b:1", "kafka"), ("s3://b/p", "s3"), ("https://www.notion.so/x", "notion"), ("https://drive.google.com/drive", "gdrive")):
        assert r.for_url(url)[0] == kind
    assert r.for_url("ftp://x") is None and r.locate("https://github.com/a/b/issues/1") == ("github", "1", "")
    assert r.web_url("confluence", {"url": "u"}, "T > A b") == "u#A-b"


def test_spark_source_over_a_connector(spark):
    def opened(origin):
        class Remote:
            def listing(self):
                return {"1": Entry("v", "a.md", "u"), "2": Entry(None, "b.md")}

            def fetch(self, items):
                for i in items:
                    yield i, Doc(f"# {origin} {i}", {"a": "u"}, {"k": ["x", ""]})

        return Remote()

    spark.dataSource.register(make_source("fake_remote", opened))
    read = lambda **o: spark.read.format("fake_remote").options(origin="o", **o).load()
    assert {(r.item_id, r.version) for r in read().collect()} == {("1", "v"), ("2", None)}
    assert {(r.item_id, r.text, tuple(r.meta["k"])) for r in read(items="1\n2\n3", batch="1").collect()} == {("1", "# o 1", ("x",)), ("2", "# o 2", ("x",))}


def test_writer_helpers():
    assert segment("A / b:c") == "A-b-c" and segment("...") == "untitled" and segment("CON") == "_CON" and len(segment("x" * 90)) == 60
    long = table(["h"], [["v" * 300]] * 5)
    assert long.count("| h |") == 3 and tidy(["a  ", "", "", "```", "", "", "```"]) == "a\n\n```\n\n\n```\n"


def test_data_cards(spark, tmp_path):
    (tmp_path / "daily_orders.jsonl").write_text('{"a": null}\n{"a": 1.5, "b": [1]}\n')
    got = files.data_card(str(tmp_path / "daily_orders.jsonl"), "x/daily_orders.jsonl", 2048)
    assert "<!-- defines: daily_orders -->" in got and "JSON Lines file on disk, 2.0 KB." in got and "| a | number |" in got and "| b | array |" in got
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next(p for p in (tmp_path / "p").iterdir() if p.suffix == ".parquet")
    assert "3 rows" in files.data_card(str(part), part.name, 10)
    assert files.data_card(str(tmp_path / "none.csv"), "none.csv", 1) is None and files.pdf_pages(b"no", "x") is None


def test_urls_name_items_however_spelled():
    same = [links.item_of_url(u) for u in ("https://X.example/browse/SHOP-1", "https://x.example/issues/?selectedIssue=SHOP-1")]
    assert same == [("x.example", "jira", "SHOP-1", "")] * 2
    assert links.item_of_url("https://h/wiki/x?pageId=5#A+b") == links.item_of_url("https://h/wiki/spaces/S/pages/5/T#A+b") == ("h", "confluence", "5", "A+b")
    assert links.item_of_url("https://h/a/b/pull/3#c") == ("h", "github", "3", "c") and links.item_of_url("mailto:x") is None and links.item_of_url(None) is None
