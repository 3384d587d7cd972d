"""Text functions as column expressions: all of them run inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions import fixed

#: Marks that the index drops from letters.
MARKS = "[̀-̱]"
#: A term of the index.
TERM = r"[\p{L}\p{N}]+"


@cache
def accent_table() -> tuple[str, str]:
    """Lower-case letters that are a Latin letter with marks, and that letter, by Unicode decomposition."""
    have, plain = [], []
    for code in range(0xC0, 0x1F00):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and ch == ch.lower():
            have.append(ch)
            plain.append(base[0])
    return "".join(have), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters; other alphabets, `đ` and `ß` stay."""
    have, plain = accent_table()
    return F.regexp_replace(F.translate(F.lower(text), have, plain), MARKS, "")


def terms(text: Column) -> Column:
    """Terms of the index in order: folded runs of letters and digits (`_` parts them)."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def head_text(path: Column, heading: Column) -> Column:
    """The text of the index's head column."""
    return F.translate(F.concat_ws(" ", path, heading), "/_-", "   ")


def is_vietnamese(text: Column) -> Column:
    """Whether a text has letters or tones that only Vietnamese writes, joined or not."""
    low, high = fixed.VIETNAMESE_RANGE
    split = "[oOuU]̛|[aA]̆|\\p{L}[̀-ͯ]*[̣̉]|[̂̆][̀́̃]|[eE]̃|[yY][̀̃]"
    return F.coalesce(text, F.lit("")).rlike(f"[{fixed.VIETNAMESE}{low}-{high}]|{split}")


def norm_name(name: Column) -> Column:
    """A name as it is compared: blanks off, parentheses off, lower case."""
    blank = " \t\n\r\x0b\x0c"
    return F.lower(F.btrim(F.btrim(name, F.lit(blank)), F.lit("()")))


def names_in(text: Column) -> Column:
    """Distinct names that a text mentions by their shape: in ticks or quotes, snake or
    camel case, ticket and repository items, three dotted parts. Null text has none."""
    body = F.coalesce(text, F.lit(""))

    def found(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(body, F.lit(pattern), F.lit(group))

    ticks = F.filter(F.transform(found(fixed.TICKS, 1), lambda x: F.btrim(x)), lambda x: x.rlike(fixed.NAME_IN_TICKS) & (F.char_length(x) >= 3))
    quoted = F.filter(found(fixed.QUOTED, 1), lambda x: F.char_length(x) <= 80)
    shapes = [found(p) for p in (fixed.SNAKE, fixed.CAMEL, fixed.PASCAL, fixed.TICKET, fixed.DOTTED, fixed.REPO_ITEM)]
    return F.array_distinct(F.transform(F.concat(ticks, quoted, *shapes), norm_name))


def slug(heading: Column) -> Column:
    """A heading as an anchor."""
    kept = F.regexp_replace(F.lower(F.btrim(heading)), rf"[^{fixed.W}\s-]", "")
    return F.regexp_replace(kept, r"\s+", "-")


def folder(path: Column) -> Column:
    """The folder of a path, without the slash; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def normal_path(path: Column) -> Column:
    """A relative path without `.`, `..` and empty parts, as far as it does not lead out."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.lit("..")

    def step(done: Column, part: Column) -> Column:
        inside = (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != up)
        return F.when((part == up) & inside, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", ".").otherwise(joined)


def link_targets(text: Column, path: Column) -> Column:
    """array<struct<target_path, target_anchor>> of the Markdown links of a text in the file `path`.

    Absolute http(s) links are kept whole, links of other schemes name nothing,
    an anchor alone is one in the same file, the rest is relative to the file's folder.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.MARKDOWN_LINK), F.lit(1))
    here = folder(path)
    web, scheme = r"(?i)^https?:", r"(?i)^[a-z][a-z0-9+.-]*:"

    def target(link: Column) -> Column:
        at = F.instr(link, "#")
        file = F.when(at > 0, F.substring_index(link, "#", 1)).otherwise(link)
        anchor = F.when(at > 0, link.substr(at + 1, F.char_length(link))).otherwise("")
        inside = F.when(file == "", path).otherwise(normal_path(F.concat_ws("/", F.when(here != "", here), file)))
        return F.when(link.rlike(web), F.struct(link.alias("target_path"), F.lit("").alias("target_anchor"))).otherwise(F.struct(inside.alias("target_path"), anchor.alias("target_anchor")))

    return F.transform(F.filter(found, lambda x: x.rlike(web) | ~x.rlike(scheme)), target)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language of a path by its suffix; null where the suffix is not known."""
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGE_OF_SUFFIX.items() for x in pair])
    return F.element_at(table, suffix(path))


def effective_language(path: Column, grammars: tuple[str, ...] = ()) -> Column:
    """The language a file is cut by: `code` where its grammar is not at hand."""
    by_suffix = language(path)
    missing = [x for x in fixed.CUT_BY_GRAMMAR if x not in grammars]
    return F.when(by_suffix.isin(missing), "code").otherwise(by_suffix)


def document_type(path: Column, lang: Column) -> Column:
    """What kind of document a file is, from its path and language alone."""
    parts = F.split(F.lower(path), r"[/_\-.]")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    test = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in fixed.TEST_WORDS])) | stem.rlike(r"(?:Tests?|Spec)$")
    return (
        F.when(lang.isin(*fixed.PROSE), fixed.ARTICLE)
        .when(lang == "data", fixed.DATASET)
        .when(lang.isin(*fixed.CONFIGURATION), fixed.CONFIG_TYPE)
        .when(test, fixed.TEST)
        .otherwise(fixed.SOURCE_CODE)
    )


def snippet(text: Column, width: int = 160) -> Column:
    """The first characters of a text without its heading and comment lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.btrim(x, F.lit(" \t")))
    body = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("<!--")), " ")
    return F.when(F.char_length(body) > width, F.concat(F.substring(body, 1, width), F.lit("…"))).otherwise(body)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a wildcard pattern; `*` crosses folders."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[^" + inside[1:] + "]" if inside[0] in "!^" else "[" + inside + "]")
            i = end
        else:
            out.append(re.sub(r"([\\.^$|+(){}\[\]])", r"\\\1", ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(value: Column, wanted: list[str]) -> Column:
    """`value` equals one of `wanted`, or fits one that has wildcards, in any case."""
    low = F.lower(value)
    tests = [low.rlike(glob_regex(v.lower())) if any(c in v for c in "*?[") else low == v.lower() for v in wanted]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def size_text(n: Column) -> Column:
    """Bytes for people: whole bytes, else one decimal of KB, MB, GB or TB."""
    out = F.concat(F.format_string("%.1f", F.bround(n / 1024.0**4, 1)), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", F.bround(n / 1024.0**power, 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def retention_text(ms: Column) -> Column:
    """How long a topic keeps its messages."""
    hours = ms.cast("double") / 3_600_000

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")

    return (
        F.when(ms.isNull(), "default")
        .when(ms.cast("bigint") < 0, "forever")
        .when(hours >= 24, F.concat(plain(hours / 24), F.lit(" days")))
        .otherwise(F.concat(plain(hours), F.lit(" hours")))
    )


def decoded(content: Column, universal: bool = False) -> Column:
    """Text of a file's bytes: null if it looks binary, UTF-8 with replacement, CR LF as LF.

    With `universal`, as a file is shown: never null, and a lone CR is a line break too.
    """
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n", "\n")
    if universal:
        return F.regexp_replace(text, "\r", "\n")
    probe = F.hex(F.substring(content, 1, fixed.BINARY_PROBE_BYTES))
    return F.when(~probe.rlike("^(?:..)*?00"), text)


def defined_names(text: Column) -> Column:
    """Names in the `<!-- defines: ... -->` line near the start of a text."""
    line = F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, 2000), r"(?m)^<!-- defines: (.+?) -->$", 1)
    return F.array_distinct(F.filter(F.split(line, r"\s+"), lambda x: x != ""))


def date_facts(text: Column) -> Column:
    """Sentences on the days between every two different ISO dates of a text, in order of the dates."""
    days = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"), F.lit(1))))
    known = F.filter(days, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())
    pairs = F.flatten(F.transform(known, lambda a: F.transform(F.filter(known, lambda b: b > a), lambda b: F.concat(a, F.lit(" is "), F.datediff(b.cast("date"), a.cast("date")).cast("string"), F.lit(" days before "), b))))
    return pairs


def coordinate(text: Column) -> Column:
    """struct<source, path, start, end> of `source:path[:start[-end]]`; null fields where it is none."""
    shape = r"^([^:/\\]+):(.+?)(?::(\d+)(?:-(\d+))?)?$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, shape, i), F.lit(""))

    start = part(3).cast("int")
    return F.struct(part(1).alias("source"), part(2).alias("path"), start.alias("start"), F.coalesce(part(4).cast("int"), start).alias("end"))
