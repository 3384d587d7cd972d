"""Tables and views of a database, a card each; never a row of them.

The catalog is read through DB-API connections (SQLite is built in, others are
registered), or from any JDBC database with Spark by `jdbc_columns`.
"""

from __future__ import annotations

import posixpath
import sqlite3
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from passagework.sources.markdown import card, fenced, segment
from passagework.sources.schema_kinds import Cards, heading_url, locate, no_query

__all__ = ["KIND", "DOC_TYPE", "Remote", "Table", "heading_url", "jdbc_columns", "locate", "origin", "table_card"]
KIND, DOC_TYPE = "sql", "Dataset"
# Databases by the scheme of their address, and schemas that are not listed.
DATABASES = frozenset("mariadb mssql mysql oracle postgres postgresql redshift snowflake sqlite".split())
SYSTEM = frozenset("information_schema mysql performance_schema pg_catalog pg_toast sys".split())


def origin(url: str, query: str | None = None) -> str | None:
    """The address without its password."""
    scheme, sep, rest = url.partition("://")
    if not sep or scheme.split("+")[0].lower() not in DATABASES:
        return None
    no_query(query)
    scheme = scheme.replace("postgres", "postgresql") if scheme == "postgres" else scheme
    place, slash, tail = rest.partition("/")
    user, at, host = place.rpartition("@")
    return f"{scheme}://{user.split(':')[0]}{at}{host}{slash}{tail}"


@dataclass
class Table:
    schema: str
    name: str
    view: bool = False
    default: bool = True
    comment: str = ""
    definition: str = ""
    columns: list[list[str]] = field(default_factory=list)  # name, type, null, default, comment
    key: list[str] = field(default_factory=list)
    foreign: list[tuple[list[str], str, str, list[str]]] = field(default_factory=list)  # columns, schema, table, columns there
    indexes: list[tuple[str, list[str], bool]] = field(default_factory=list)

    @property
    def id(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def title(self) -> str:
        return self.name if self.default else self.id

    @property
    def path(self) -> str:
        return f"{segment(self.schema)}/{segment(self.name)}.md"


def table_card(where: str, t: Table, tables: dict[str, Table]) -> str:
    """A table's card: columns, keys, both sides of its references, indexes, a view's text."""
    ticks = lambda xs: "`" + ", ".join(xs) + "`"
    to = lambda o: f"[{o.title}]({posixpath.relpath(o.path, posixpath.dirname(t.path))})"
    about = [f"{'View' if t.view else 'Table'} in `{where}`, schema `{t.schema}`.", *(["", t.comment] if t.comment else [])]
    sections = []
    if t.foreign:
        rows = []
        for columns, schema, name, there in t.foreign:
            other = tables.get(f"{schema}.{name}")
            rows.append(f"- {ticks(columns)} → {to(other) if other else f'`{schema}.{name}`'} ({ticks(there)})")
        sections.append(("References", rows))
    back = [f"- {to(o)} ({ticks(columns)})" for o in tables.values() for columns, schema, name, _ in o.foreign if f"{schema}.{name}" == t.id]
    sections.append(("Referenced by", back))
    sections.append(("Indexes", [f"- `{name}` on {ticks(columns)}" + (" (unique)" if unique else "") for name, columns, unique in t.indexes]))
    more = [f"**Primary key:** {ticks(t.key)}", ""] if t.key else []
    for name, rows in sections:
        more += [f"**{name}:**", *rows, ""] if rows else []
    if t.definition:
        more += ["**Definition:**", *fenced(t.definition.strip(), "sql")]
    return card(t.title, about, ["Column", "Type", "Null", "Default", "Comment"], t.columns, more, [t.id, t.name])


def sqlite_tables(path: str) -> dict[str, Table]:
    with sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True) as con:
        out = {}
        for name, kind, sql in con.execute("SELECT name, type, sql FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY type, name").fetchall():
            t = Table("main", name, kind == "view", definition=sql if kind == "view" else "")
            info = con.execute("SELECT name, type, \"notnull\", dflt_value, pk FROM pragma_table_info(?)", (name,)).fetchall()
            t.columns = [[c, ty, "no" if nn or pk else "yes", d or "", ""] for c, ty, nn, d, pk in info]
            t.key = [c for c, *_, pk in sorted(info, key=lambda r: r[4]) if pk]
            for _, there, mine, theirs in con.execute('SELECT id, "table", group_concat("from"), group_concat("to") FROM pragma_foreign_key_list(?) GROUP BY id', (name,)).fetchall():
                t.foreign.append((mine.split(","), "main", there, (theirs or "").split(",")))
            for index, unique in con.execute("SELECT name, \"unique\" FROM pragma_index_list(?) WHERE origin = 'c'", (name,)).fetchall():
                t.indexes.append((index, [c for (c,) in con.execute("SELECT name FROM pragma_index_info(?)", (index,)).fetchall() if c], bool(unique)))
            out[t.id] = t
        return out


#: Reads the tables of an address, by the scheme's first part.
CATALOGS: dict[str, Callable[[str], dict[str, Table]]] = {"sqlite": lambda address: sqlite_tables(address.split(":///", 1)[1])}


class Remote(Cards):
    def __init__(self, origin_url: str):
        super().__init__()
        self.origin = origin_url
        scheme, _, rest = origin_url.partition("://")
        self.scheme = scheme.split("+")[0]
        base = posixpath.basename(rest.split("?")[0]).split(".")[0] or rest.split("/")[0].rpartition("@")[2].split(":")[0] or "db"
        self.name = f"{self.scheme}-{base}"

    def listing(self):
        from passagework.sources.remote import RemoteError

        if self.scheme not in CATALOGS:
            raise RemoteError(f"no catalog reader for {self.scheme}; register one, or use jdbc_columns")
        tables = {i: t for i, t in CATALOGS[self.scheme](self.origin).items() if t.schema not in SYSTEM and not t.schema.startswith("pg_")}
        return {i: self.keep(i, t.path, table_card(self.origin, t, tables)) for i, t in tables.items()}


def jdbc_columns(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """(name, position, column, type) of a database's tables, for `files.table_cards`; reads its catalog alone."""
    query = "SELECT table_schema || '.' || table_name AS name, ordinal_position AS position, column_name AS \"column\", data_type AS type FROM information_schema.columns"
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
