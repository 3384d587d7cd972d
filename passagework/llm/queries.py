"""Queries of the training-text problems, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import canonical, distinctive, frequency, leakage, lookalikes, neardup, packing, splitting
from passagework.session import materialize, shared_dir
from passagework.sources.tables import table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every section and block that is too long."""
    return splitting.split_texts(table(spark, d, "chunks"), ["id", "heading_path"])


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each chunk that is too long: the hash of its pieces put together, whether all are within the limit,
    and whether each piece after the first repeats what the one before ends with."""
    piece = p1_pieces(spark, d).select("id", F.struct("start_char", "overlap_chars", "text").alias("p"))
    whole = piece.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.substr(x["text"], x["overlap_chars"] + 1)), "")
    within = F.forall("p", lambda x: (F.char_length(x["text"]) <= splitting.LIMIT) & (F.char_length(x["text"]) > x["overlap_chars"]))
    repeats = F.transform("p", lambda x, i: (i == 0) | (x["overlap_chars"] > 0) & F.endswith(F.get("p", i - 1)["text"], F.substr(x["text"], F.lit(1), x["overlap_chars"])))
    return whole.select(F.col("id").alias("chunk_id"), F.md5(joined).alias("md5"), within.alias("within"), F.forall(repeats, lambda x: x).alias("repeats"))


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """All file texts, written to long files of the shared folder and split by byte range: what comes out must be what went in."""
    texts = table(spark, d, "file_texts").select(F.coalesce("text", F.lit("")).alias("value"))
    path = f"{shared_dir(spark).rstrip('/')}/tables/long-files-{uuid.uuid4().hex}"
    texts.coalesce(8).write.text(path)
    made = splitting.split_files(spark, [path], range_bytes=1 << 16)
    new = F.char_length("text") - F.col("overlap_chars")
    return made.agg(F.sum(new).cast("bigint").alias("chars"), F.sum(F.char_length(F.translate(F.substr("text", F.col("overlap_chars") + 1), "\n", ""))).cast("bigint").alias("chars_in_lines"), (F.max(F.char_length("text")) <= splitting.LIMIT).alias("within"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_lines(p1_pieces(spark, d), "id").withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, name, id in (("chunk", "chunks", "id"), ("file", "file_texts", "file_id")):
        pairs = neardup.near_duplicate_pairs(table(spark, d, name), id, "text").select(F.lit(kind).alias("record_kind"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk and file that takes part, with the group of its copies and near copies."""
    out = None
    for kind, name, id in (("chunk", "chunks", "id"), ("file", "file_texts", "file_id")):
        groups = neardup.near_duplicate_groups(table(spark, d, name), id, "text", neardup.MAP_TEXTS).select(F.lit(kind).alias("record_kind"), "id", "group_id")
        out = groups if out is None else out.unionByName(groups)
    return out


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every word of every chunk."""
    scored = distinctive.distinctive_terms(table(spark, d, "chunks"))
    return scored.select(F.col("id").alias("chunk_id"), "term", "tf", "n_records", F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.distinctive_terms(table(spark, d, "chunks"))
    # The rows are those that have a score; each has, and it is computed.
    return scored.where((F.col("score") > 0) & (F.col("tf") >= 4) & (F.col("n_records") <= 3) & (F.char_length("term") >= 2)).select(F.col("id").alias("chunk_id"), "term")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Rows, chunks and mark of every name, by role."""
    return frequency.term_frequencies(table(spark, d, "idents"), "chunk_id", "ident", "role")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_frequencies(spark, d).where(F.col("mark").isNotNull()).select("ident", "role", "mark")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one that is too long."""
    return packing.packed(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # A long document's first piece fills a container; the pack is whole before it is filtered.
    return materialize(p6_containers(spark, d), "packed").where("n_pieces > 1 and piece_no = 1").select("doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: one row a number of containers with the same room left."""
    per = p6_containers(spark, d).groupBy("container").agg((packing.CAPACITY - F.sum("n_tokens")).cast("int").alias("room"))
    return per.groupBy("room").agg(F.count(F.lit(1)).alias("containers"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each document with tokens: how many lie in containers, in how many pieces, and whether none of its containers is too full."""
    pack = materialize(p6_containers(spark, d), "packed")
    full = pack.groupBy("container").agg((F.sum("n_tokens") <= packing.CAPACITY).alias("fits"))
    return pack.join(full, "container").groupBy("doc_id").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.every("fits").alias("fits"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents, the items that stand in them, and the longest run of words in common with its places."""
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p7_shards(spark: SparkSession, d: str) -> DataFrame:
    """The same from stored suffix arrays of all documents."""
    return leakage.SuffixShards.build(table(spark, d, "documents")).search(table(spark, d, "bench_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents in which no item stands."""
    return leakage.without_leaks(table(spark, d, "documents").select("doc_id"), p7_matches(spark, d))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its one form of writing."""
    return canonical.canonical_texts(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "canonical")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a document that looks like one with other characters, with the least id of its look."""
    return lookalikes.look_alike_classes(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_checks, p1_files, p3_found, p3_groups, p4_found, p4_scores, p5_found, p5_frequencies, p6_found, p6_containers, p6_checks, p6_fill, p7_found, p7_matches, p7_shards, p7_clean, p8_found, p8_texts, p8_groups)}

def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _look_sql(column: str) -> str:
    """The look of a text in SQL: joined accents, then every sign by what the table makes of it, then joined again."""
    changed = {c: canonical.fold(c) for c in map(chr, canonical.folded_signs())}
    one = {c: to for c, to in changed.items() if len(to) == 1}
    gone = [c for c, to in changed.items() if not to]
    sql = f"translate(nfc_normalize({column}), {_quoted(''.join([*one, *gone]))}, {_quoted(''.join(one.values()))})"
    for c, to in changed.items():
        if len(to) > 1:
            sql = f"replace({sql}, {_quoted(c)}, {_quoted(to)})"
    return f"replace(nfc_normalize({sql}), chr(13) || chr(10), chr(10))"


def _leak_words_sql(column: str) -> str:
    """The words of a text for matching, in SQL: lower case, look-alikes merged, outer underscores off."""
    changed = {c: canonical.fold_caseless(c) for c in map(chr, canonical.folded_signs(canonical.fold_caseless))}
    one = {c: to for c, to in changed.items() if len(to) == 1}
    gone = [c for c, to in changed.items() if not to]
    sql = f"translate(nfc_normalize(lower({column})), {_quoted(''.join([*one, *gone]))}, {_quoted(''.join(one.values()))})"
    for c, to in changed.items():
        if len(to) > 1:
            sql = f"replace({sql}, {_quoted(c)}, {_quoted(to)})"
    return rf"list_filter(list_transform(regexp_extract_all(nfc_normalize({sql}), '[\p{{L}}\p{{N}}_]+'), lambda x: trim(x, '_')), lambda x: x <> '')"


_RUNS = "list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))"
_LOOKS = f"WITH l AS (SELECT doc_id, text, {_look_sql('text')} AS look FROM documents WHERE text <> '')"
_NAME = "lower(trim(trim(ident, ' '), '()'))"
_COUNTS = f"""
SELECT ident, role, sum(n) AS n_rows, count(chunk_id) AS n_records
FROM (SELECT {_NAME} AS ident, role, chunk_id, count(*) AS n FROM idents WHERE {_NAME} <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2
"""
_MARK = """CASE WHEN role = 'mentions' AND n_records > 5 OR role = 'defines' AND n_records > 3 THEN 'common'
            WHEN role = 'mentions' AND n_records = 1 THEN 'rare' END"""
_TERMS = r"""
WITH w AS (SELECT id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x))) AS term FROM chunks),
c AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2),
v AS (SELECT term, count(*) AS n_records, sum(tf) AS n_rows FROM c GROUP BY 1)
"""
_SHINGLES = r"""
WITH RECURSIVE t AS (SELECT 'chunk' AS kind, id, text FROM chunks UNION ALL SELECT 'file', file_id, text FROM file_texts),
l AS (SELECT kind, id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM t),
g AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM l WHERE len(w) >= 20),
n AS (SELECT kind, id, count(*) AS n FROM g GROUP BY 1, 2),
b AS (SELECT x.kind, x.id AS a, y.id AS b, count(*) AS shared FROM g x JOIN g y ON x.kind = y.kind AND x.s = y.s AND x.id < y.id GROUP BY 1, 2, 3),
p AS (SELECT b.kind AS record_kind, b.a AS id_a, b.b AS id_b FROM b
JOIN n x ON x.kind = b.kind AND x.id = b.a JOIN n y ON y.kind = b.kind AND y.id = b.b
WHERE shared >= 0.6 * (x.n + y.n - shared) - 1e-9)
"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, {_leak_words_sql('text')} AS w FROM documents WHERE text <> ''),
i AS (SELECT item_id, {_leak_words_sql('passage')} AS w FROM bench_items WHERE passage <> ''),
x AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS run FROM i WHERE len(w) >= 12),
y AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS run FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (run)
"""

_TOKENS = r"""len(regexp_extract_all(coalesce(text, ''),
'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"""

ORACLE = {
    "p1_found": """
WITH c AS (SELECT id, coalesce(start_line, 1) AS start_line, string_split(text, chr(10)) AS lines FROM chunks WHERE length(text) > 1500),
l AS (SELECT id, unnest(range(1, len(lines) + 1)) AS i, lines, start_line FROM c),
x AS (SELECT id, start_line + i - 1 AS line_no FROM l WHERE length(lines[i]) > 1500)
SELECT id AS chunk_id, CAST(line_no AS BIGINT) AS line_no FROM x
UNION ALL SELECT id, CAST(0 AS BIGINT) FROM c WHERE id NOT IN (SELECT id FROM x)
""",
    "p1_checks": "SELECT id AS chunk_id, md5(text) AS md5, true AS within, true AS repeats FROM chunks WHERE length(text) > 1500",
    "p1_files": """
SELECT CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars, CAST(sum(length(replace(coalesce(text, ''), chr(10), ''))) AS BIGINT) AS chars_in_lines, true AS within
FROM file_texts
""",
    "p3_found": _SHINGLES + "SELECT * FROM p",
    "p3_groups": _SHINGLES
    + """, e AS (SELECT record_kind AS kind, id_a AS a, id_b AS b FROM p UNION SELECT record_kind, id_b, id_a FROM p),
r AS (SELECT kind, id AS a, id AS b FROM n UNION SELECT r.kind, r.a, e.b FROM r JOIN e ON e.kind = r.kind AND e.a = r.b)
SELECT kind AS record_kind, a AS id, min(b) AS group_id FROM r GROUP BY 1, 2""",
    "p4_found": _TERMS + "SELECT id AS chunk_id, term FROM c JOIN v USING (term) WHERE tf >= 4 AND n_records <= 3 AND length(term) >= 2",
    "p4_scores": _TERMS
    + """
, len AS (SELECT id, sum(tf) AS len FROM c GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(tf) FROM c) AS words),
s AS (SELECT c.id, term, tf, n_records, tf * log2(1 + (words / n) / len) AS tfn, n_rows / n AS rate FROM c JOIN v USING (term) JOIN len ON len.id = c.id, n)
SELECT id AS chunk_id, term, CAST(tf AS INTEGER) AS tf, n_records, round((log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1), 6) AS score FROM s
""",
    "p5_found": f"SELECT * FROM (SELECT ident, role, {_MARK} AS mark FROM ({_COUNTS})) WHERE mark IS NOT NULL",
    "p5_frequencies": f"SELECT ident, role, CAST(n_rows AS BIGINT) AS n_rows, n_records, {_MARK} AS mark FROM ({_COUNTS})",
    "p7_found": _LEAKS,
    "p7_clean": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_LEAKS}))",
    "p8_found": _LOOKS + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM l a JOIN l b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p8_groups": _LOOKS
    + """, m AS (SELECT look, min(doc_id) AS group_id FROM l GROUP BY 1 HAVING count(DISTINCT text) > 1)
SELECT doc_id, group_id FROM l JOIN m USING (look)""",
    "p6_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 1024",
    "p6_checks": f"SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS n_tokens, CAST(ceil({_TOKENS} / 1024.0) AS BIGINT) AS n_pieces, true AS fits FROM documents WHERE {_TOKENS} > 0",
}
