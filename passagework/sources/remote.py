"""Sources that are not a folder: the connector contract, its registry, and a Spark data source over it.

A connector is a module or object with

    KIND                     its name
    DOC_TYPE                 optional: the document type of all its files
    origin(url, query)       the canonical address of a source of this kind, or None
    locate(url)              (item, fragment) of an item's address, or None
    heading_url(item, heads) where a section of an item is on the web, or None
    Remote(origin)           with name, FORMAT, listing() -> {item: Entry} and
                             fetch(items) -> (item, Doc), an item at a time
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.client import IncompleteRead
from importlib.metadata import entry_points

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RemoteError(RuntimeError):
    """A remote source refused or failed."""


@dataclass
class Entry:
    """An item as a listing has it; `version` changes when the item does."""

    version: str | None
    path: str
    url: str = ""


@dataclass
class Doc:
    """An item as Markdown, with the addresses of its sections and the fields to filter by."""

    text: str
    anchors: dict[str, str] = field(default_factory=dict)
    meta: dict[str, list[str]] = field(default_factory=dict)


class Registry:
    """Connectors by kind. A plugin that fails is reported and left out; no plugin takes a kind that is there."""

    def __init__(self, built_in: dict[str, object]):
        self.kinds = dict(built_in)
        self.problems: list[str] = []

    def add(self, name: str, load: Callable[[], object]) -> None:
        try:
            module = load()
            kind = module.KIND
        except Exception as e:  # noqa: BLE001 - a plugin must not stop the rest
            self.problems.append(f"connector {name} not loaded: {type(e).__name__}: {e}")
            return
        if kind in self.kinds:
            self.problems.append(f"connector {name} not loaded: kind {kind!r} is taken")
            return
        self.kinds[kind] = module

    def add_installed(self, group: str = "passagework.connectors") -> Registry:
        for ep in entry_points(group=group):
            self.add(ep.name, ep.load)
        return self

    def for_url(self, url: str, query: str | None = None) -> tuple[str, str] | None:
        """(kind, origin) of an address that can be synced."""
        for kind, module in self.kinds.items():
            if (found := module.origin(url, query)) is not None:
                return kind, found
        return None

    def locate(self, url: str) -> tuple[str, str, str] | None:
        """(kind, item, fragment) of an address that names one item."""
        for kind, module in self.kinds.items():
            if (found := module.locate(url)) is not None:
                return kind, *found
        return None

    def web_url(self, kind: str, item: dict, heading_path: str) -> str | None:
        return self.kinds[kind].heading_url(item, [h for h in heading_path.split(" > ") if h])


def built_in() -> Registry:
    from passagework.sources import confluence, drive, github, jira, kafka, notion, objects, sqlcatalog

    modules = (confluence, jira, sqlcatalog, kafka, objects, notion, drive, github)
    return Registry({m.KIND: m for m in modules})


class Client:
    """JSON over HTTP, with patience: busy answers, time-outs and cut answers are tried again."""

    # Answers after which a request is repeated, and how often it is sent.
    AGAIN, TIMES = (429, 500, 502, 503, 504), 5

    def __init__(self, base: str, headers: dict[str, str] | None = None, wait: Callable[[float], None] = time.sleep):
        self.base, self.headers, self.wait = base.rstrip("/"), {"Accept": "application/json", **(headers or {})}, wait

    def get(self, path: str, **params):
        return json.loads(self.raw(path, **params))

    def post(self, path: str, body: dict):
        return json.loads(self._send(path, {}, json.dumps(body).encode()))

    def raw(self, path: str, **params) -> bytes:
        return self._send(path, params, None)

    def _send(self, path: str, params: dict, body: bytes | None) -> bytes:
        url = path if path.startswith(("http://", "https://")) else self.base + path
        if params:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params, doseq=True)
        plain = url.split("?")[0]
        headers = dict(self.headers)
        if body is not None:
            headers["Content-Type"] = "application/json"
        for left in range(self.TIMES - 1, -1, -1):
            pause = 2.0 ** (self.TIMES - 1 - left)
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=60) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code not in self.AGAIN or not left:
                    raise RemoteError(f"{e.code} {e.reason} from {plain}") from None
                pause = float(e.headers.get("Retry-After") or pause)
            except (OSError, IncompleteRead) as e:
                if not left:
                    raise RemoteError(f"cannot reach {plain}: {getattr(e, 'reason', e)}") from None
            self.wait(pause)
        raise AssertionError


def clean_meta(fields: dict) -> dict[str, list[str]]:
    """Fields as lists of their values that are not empty; fields without one are dropped."""
    lists = {k: [v] if isinstance(v, str) else list(v or []) for k, v in fields.items()}
    return {k: kept for k, vs in lists.items() if (kept := [v for v in vs if v])}


LISTING = "item_id string, version string, path string, url string"
DOCUMENTS = "item_id string, text string, anchors map<string,string>, meta map<string,array<string>>"


class ItemBatch(InputPartition):
    def __init__(self, items: list[str]):
        self.items = items


def make_source(name: str, open_remote: Callable[[str], object]) -> type[DataSource]:
    """A Spark data source `name` over a connector's Remote.

    `.option("origin", ...)`; with `.option("items", "a\\nb")` it reads those
    documents, in batches that run as tasks, else the listing.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.origin = options["origin"]
            self.items = options["items"].split("\n") if options.get("items") else None
            self.size = int(options.get("batch", "50"))

        def partitions(self):
            if self.items is None:
                return [ItemBatch([])]
            return [ItemBatch(self.items[i : i + self.size]) for i in range(0, len(self.items), self.size)]

        def read(self, partition: ItemBatch) -> Iterator[tuple]:
            remote = open_remote(self.origin)
            entries = remote.listing()
            if self.items is None:
                for item, e in entries.items():
                    yield item, e.version, e.path, e.url
                return
            for item, doc in remote.fetch([i for i in partition.items if i in entries]):
                yield item, doc.text, doc.anchors, clean_meta(doc.meta)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return DOCUMENTS if self.options.get("items") else LISTING

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source
