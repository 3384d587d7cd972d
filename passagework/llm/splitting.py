"""Splitting oversized texts at natural boundaries, range by range.

A text is worked in ranges of characters (rows) or bytes (files); no step holds
more than a range with its halos:

1. Each range reports a boundary row: its characters, its line breaks and the
   place of the last of them.
2. The boundary rows of a text are stitched by window functions: prefix sums
   give the character and the line at which a range begins, the last break
   before it gives the start of the line that crosses into it.
3. Each range emits its pieces by offset.

Every text takes this way, whatever its length. Cuts do not depend on the
ranges: a text is laid out in stretches that begin at the first strong boundary
at or after each multiple of `STRETCH` limits, counted in characters of the
whole text, and a stretch is cut by itself. The range in which that multiple
lies emits it; its halo covers what the stretch may need beyond.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.session import materialize

LIMIT = 1500
OVERLAP = 150
#: Limits in a stretch.
STRETCH = 4
#: Bytes of a file that a worker reads at a time.
RANGE = 1 << 20
#: Most tasks that read ranges; each streams through its share of them.
TASKS = 100_000

#: Natural boundaries from strong to weak; each matches just before the cut.
BREAKS = (
    re.compile(r"\n[ \t]*\n+"),  # blank line
    re.compile(r"\n(?=[ \t]*(?:#{1,6} |[-*+•] |\d+[.)] |```|def |class |function |CREATE ))"),  # line that opens something
    re.compile(r"\n"),
    re.compile(r"[.!?;:…。！？][\"'”’)\]]*\s+"),  # end of a sentence or clause
    re.compile(r"\s+"),
)


def _last_break(text: str, low: int, high: int) -> int | None:
    """The end of the last strongest boundary in (low, high], or None."""
    for pattern in BREAKS:
        best = None
        # A match may begin before `low` and may not reach beyond `high`.
        for m in pattern.finditer(text, max(0, low - 8), min(len(text), high + 8)):
            if low < m.end() <= high:
                best = m.end()
        if best is not None:
            return best
    return None


def overlap_start(text: str, cut: int, overlap: int) -> int:
    """Where the repeat before `cut` begins: at the line start nearest to
    `overlap` characters back, if one lies within half of that, else exactly there."""
    want = cut - overlap
    if want <= 0:
        return 0
    lines = [m.end() for m in re.compile("\n").finditer(text, max(0, want - overlap // 2 - 1), want + overlap // 2) if abs(m.end() - want) <= overlap // 2]
    return min(lines, key=lambda p: (abs(p - want), p)) if lines else want


def cuts(text: str, start: int, end: int, first: bool, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(repeat start, new start, end) of the pieces of text[start:end].

    With `first`, no text precedes `start` and the first piece repeats nothing.
    A cut is natural wherever white space allows one; otherwise it falls at the
    limit, but never before a combining sign or inside a CR LF.
    """
    at = start
    while at < end:
        begin = at if first and at == start else overlap_start(text, at, overlap)
        room = limit - (at - begin)
        if end - at <= room:
            stop = end
        else:
            high = min(at + room, max(at + room // 2, end - overlap))  # leave no crumb for the last piece
            stop, top = None, high
            for low in (room // 2, room // 4, overlap, 0):  # a short piece only for want of a later boundary
                if stop is None and at + low < top:
                    stop, top = _last_break(text, at + low, top), at + low
            if stop is None:
                stop = high
                while stop > at + 1 and (_combining(text[stop]) or text[stop - 1 : stop + 1] == "\r\n"):
                    stop -= 1
        yield begin, at, stop
        at = stop


def _combining(ch: str) -> bool:
    return "̀" <= ch <= "ͯ" or "︀" <= ch <= "️" or ch in "‍⃣"


def anchor(text: str, at: int, reach: int) -> int:
    """Where the stretch of the grid place `at` begins: behind the first strong boundary within `reach`."""
    for pattern in (BREAKS[0], BREAKS[2], BREAKS[4]):
        if (m := pattern.search(text, at, at + reach)) and m.end() < at + reach:
            return m.end()
    for back in range(min(at, 8)):  # not before a combining sign or inside a CR LF
        if not _combining(text[at - back : at - back + 1] or " ") and text[at - back - 1 : at - back + 1] != "\r\n":
            return at - back
    return at


#: What a piece is, beside the key columns.
PIECE = pa.schema(
    [
        ("start_char", pa.int64()),
        ("end_char", pa.int64()),
        ("overlap_chars", pa.int32()),
        ("start_line", pa.int64()),
        ("end_line", pa.int64()),
        ("long_lines", pa.list_(pa.int64())),
        ("text", pa.string()),
    ]
)
PIECE_DDL = "start_char bigint, end_char bigint, overlap_chars int, start_line bigint, end_line bigint, long_lines array<bigint>, text string"
#: A boundary row, beside the key of its text.
BOUNDARY_DDL = "__range bigint, chars bigint, breaks bigint, last bigint"
BOUNDARY = pa.schema([(n, pa.int64()) for n in ("__range", "chars", "breaks", "last")])


def boundary(body: str) -> tuple[int, int, int | None]:
    """(characters, line breaks, place behind the last break) of a range."""
    breaks = body.count("\n")
    return len(body), breaks, body.rfind("\n") + 1 if breaks else None


class Sizes:
    """The measures of a split, and what halos they ask for."""

    def __init__(self, limit: int, overlap: int):
        if limit < 4 * overlap or overlap < 0:
            raise ValueError("the limit must be at least four overlaps")
        self.limit, self.overlap, self.stretch = limit, overlap, STRETCH * limit
        self.before = 2 * overlap + 16
        #: A strong boundary is looked for in so many characters behind a grid place.
        self.reach = 2 * limit
        self.after = self.stretch + self.reach + 2 * limit + 16

    def stretches(self, total: int) -> int:
        """How many stretches a text of `total` characters has; no rest within the reach stands alone."""
        return max(1, (total - self.reach) // self.stretch + 1)


def emitted(head: str, body: str, tail: str, base: int, line: int, before: int, total: int, sizes: Sizes) -> Iterator[tuple]:
    """Pieces of the stretches whose grid place lies in a range.

    `base` and `line` are the character and the line at which the range begins,
    `before` the place behind the last line break ahead of it, all of the whole
    text. The window goes on for a limit behind the last stretch, or to the end.
    """
    window, origin = head + body + tail, base - len(head)
    line -= head.count("\n")
    at, number = 0, line  # a place in the window and its line; both only go on
    limit, stretch, count = sizes.limit, sizes.stretch, sizes.stretches(total)
    for k in range(-(-base // stretch), min(count, -(-(base + len(body)) // stretch))):
        start = anchor(window, k * stretch - origin, sizes.reach) if k else -origin
        end = total - origin if k == count - 1 else anchor(window, (k + 1) * stretch - origin, sizes.reach)
        for begin, new, stop in cuts(window, start, end, k == 0, limit, sizes.overlap):
            number += window.count("\n", at, begin)
            at = begin
            yield origin + begin, origin + stop, new - begin, number, number + window.count("\n", begin, stop - 1), _long_lines(window, origin, begin, number, new, stop, before, limit), window[begin:stop]


def _long_lines(window: str, origin: int, begin: int, number: int, new: int, stop: int, before: int, limit: int) -> list[int]:
    """Numbers of the lines that the characters new..stop touch and that alone exceed the limit."""
    out = []
    left = window.rfind("\n", 0, new) + 1
    number += window.count("\n", begin, left) if left > begin else -window.count("\n", left, begin)
    at_left = origin + left if left else min(before, origin)
    while left < stop:
        nl = window.find("\n", left)
        if origin + (nl if nl >= 0 else len(window)) - at_left > limit:
            out.append(number)
        if nl < 0:
            break
        left, number = nl + 1, number + 1
        at_left = origin + left
    return out


def _stitched(rows: DataFrame, key: list[str]) -> DataFrame:
    """Boundary rows with what lies before and after each range of its text.

    One short row a range, whatever its size: even a text of a terabyte has but a million.
    """
    order = Window.partitionBy(*key).orderBy("__range")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("base", F.coalesce(F.sum("chars").over(past), F.lit(0))).withColumn("lines", F.coalesce(F.sum("breaks").over(past), F.lit(0)))
    return placed.select(
        *key,
        "__range",
        "base",
        "lines",
        F.coalesce(F.last(F.col("base") + F.col("last"), ignorenulls=True).over(past), F.lit(0)).alias("before"),
        F.sum("chars").over(Window.partitionBy(*key)).alias("total"),
    )


def split_texts(records: DataFrame, keys: list[str], text: str = "text", start_line: str | None = "start_line", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int | None = None) -> DataFrame:
    """Pieces of the texts of `records` that are longer than `limit` characters.

    Result: `keys`, start_char, end_char (of the text, with the repeat; their
    order is that of the pieces), overlap_chars, start_line, end_line (`start_line` of the record
    counts as the first), long_lines (numbers of the lines under the piece's
    new characters that alone exceed the limit), text. Every piece has at most
    `limit` characters, and each after the first repeats the last `overlap`
    characters or the whole lines nearest to them; without the repeats the
    pieces of a text concatenate to it. Null texts, and texts within the limit,
    have no pieces; a null `start_line` counts as 1; keys may be null and may
    repeat. Other columns may bear any name. The pieces do not depend on
    `range_chars` (a stretch unless given).
    """
    sizes = Sizes(limit, overlap)
    span = range_chars or sizes.stretch
    if span < 1:
        raise ValueError("a range has at least one character")
    # On ranges that begin on the grid, a stretch ends within the reach.
    after = sizes.reach + 2 * limit + 16 if span % sizes.stretch == 0 else sizes.after
    line = F.coalesce(F.col(start_line).cast("bigint"), F.lit(1)) if start_line else F.lit(1).cast("bigint")
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    over = records.where(F.char_length(F.col(text)) > limit).select(key.alias("key"), line.alias("line"), F.col(text).alias("body"))
    # Rows that agree in everything have the same pieces; any other two are told apart by this.
    over = over.select("key", "line", F.md5(F.concat_ws("\0", F.to_json("key"), "line", "body")).alias("uid"), "body")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, body in enumerate(batch.column(3).to_pylist()):
                for n, a in enumerate(range(0, len(body), span)):
                    b = min(len(body), a + span)
                    which.append(i)
                    rows.append((n, *boundary(body[a:b]), body[max(0, a - sizes.before) : a], body[a:b], body[b : b + after]))
            held = [batch.column(i).take(pa.array(which, pa.int64())) for i in range(3)]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate([*BOUNDARY.types, pa.string(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays(held + made, names=["key", "line", "uid", *BOUNDARY.names, "head", "body", "tail"])

    key_ddl = f"key {over.schema['key'].dataType.simpleString()}, line bigint, uid string"
    cut = materialize(over.mapInArrow(ranges, f"{key_ddl}, {BOUNDARY_DDL}, head string, body string, tail string"), "ranges")
    placed = _stitched(cut.select("uid", *BOUNDARY.names).distinct(), ["uid"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            columns = [batch.column(n).to_pylist() for n in ("head", "body", "tail", "base", "line", "lines", "before", "total")]
            for i, (head, body, tail, base, first, lines, before, total) in enumerate(zip(*columns)):
                made = list(emitted(head, body, tail, base, first + lines, before, total, sizes))
                which += [i] * len(made)
                rows += made
            yield _pieces(batch.column(batch.schema.get_field_index("key")).take(pa.array(which, pa.int64())), "key", rows)

    done = cut.drop("chars", "breaks", "last").join(placed, ["uid", "__range"]).mapInArrow(emit, f"key {over.schema['key'].dataType.simpleString()}, {PIECE_DDL}")
    return done.select(*[F.col("key")[f"k{i}"].alias(k) for i, k in enumerate(keys)], *PIECE.names)


def _pieces(key: pa.Array, name: str, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *[pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PIECE)]], names=[name, *PIECE.names])


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """Pieces of whole files or folders of files, with the columns of `split_texts` and `path` as key.

    A first pass reads each range for its boundary row alone, a second reads it
    with its halos and emits; no task holds a whole file, and no text goes
    through a shuffle. Ranges begin at whole UTF-8 characters; bytes that are no
    UTF-8 become U+FFFD. Files within the limit come out as one piece; empty
    files have none. The pieces do not depend on `range_bytes`.
    """
    if range_bytes < 4:
        raise ValueError("a range has at least the four bytes of a character")
    sizes = Sizes(limit, overlap)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size")).where("size > 0")
    ranges = listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / range_bytes))).alias("__range"))
    total = listed.agg(F.sum(F.ceil(F.col("size") / range_bytes))).head()[0] or 0
    tasks = int(max(1, min(total, TASKS)))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [boundary(_range(path, size, i, range_bytes, 4, 4)[1]) for path, size, i in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in made], pa.int64()) for k in range(3)]], names=["path", "size", *BOUNDARY.names])

    seen = materialize(ranges.repartition(tasks, "path", "__range").mapInArrow(bounds, f"path string, size bigint, {BOUNDARY_DDL}"), "boundaries")
    placed = _stitched(seen, ["path"]).join(seen.select("path", "size", "__range"), ["path", "__range"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("path", "size", "__range", "base", "lines", "before", "total")]
            for path, size, i, base, lines, before, total in zip(*columns):
                head, body, tail = _range(path, size, i, range_bytes, 4 * sizes.before, 4 * sizes.after)
                rows = list(emitted(head, body, tail, base, 1 + lines, before, total, sizes))
                yield _pieces(pa.array([path] * len(rows), pa.string()), "path", rows)

    return placed.repartition(tasks, "path", "__range").mapInArrow(emit, f"path string, {PIECE_DDL}")


def _range(path: str, size: int, i: int, range_bytes: int, before: int, after: int) -> tuple[str, str, str]:
    """Head, body and tail of a file's range, read by offset."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path)) if ":/" in path else (fs.LocalFileSystem(), path)
    a, b = i * range_bytes, min(size, (i + 1) * range_bytes)
    low, high = max(0, a - before), min(size, b + after)
    with system.open_input_file(where) as f:
        f.seek(low)
        data = f.read(high - low)
    return _whole(data, a - low, b - low, low == 0, high == size)


def _whole(data: bytes, a: int, b: int, at_start: bool, at_end: bool) -> tuple[str, str, str]:
    """Head, body and tail as text; a character belongs to the range in which its first byte lies."""

    def forward(p: int) -> int:
        stop = min(len(data), p + 3)
        while p < stop and data[p] & 0xC0 == 0x80:
            p += 1
        return p

    a, b = forward(a) if a else a, forward(b)
    first = 0 if at_start else forward(0)
    last = len(data)
    if not at_end:  # drop a character that is cut at the end
        back = last - 1
        while back > b and back > last - 4 and data[back] & 0xC0 == 0x80:
            back -= 1
        if back > b and data[back] & 0x80:
            last = back
    return tuple(data[x:y].decode("utf-8", "replace") for x, y in ((first, a), (a, b), (b, last)))


def oversized_lines(split: DataFrame, key: str) -> DataFrame:
    """(key, line_no): the lines of a split record that alone exceed the limit, or 0 where it has none."""
    lines = split.select(key, F.explode_outer("long_lines").alias("line_no")).distinct()
    most = F.max("line_no").over(Window.partitionBy(key))
    kept = lines.withColumn("most", most).where(F.col("line_no").isNotNull() | F.col("most").isNull())
    return kept.select(key, F.coalesce("line_no", F.lit(0).cast("bigint")).alias("line_no"))
