"""SQL twins of the queries, as DuckDB runs them over the same tables.

Common table expressions are named parts; `sql` puts those that a statement
needs, and what they need themselves, in front of it.
"""

from __future__ import annotations

import re

from passagework.functions import fixed
from passagework.functions.text import accent_table
from passagework.functions.words import SPACE

_HAVE, _PLAIN = accent_table()
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}]+"


def fold(x: str) -> str:
    return rf"regexp_replace(translate(lower({x}), '{_HAVE}', '{_PLAIN}'), '[\x{{0300}}-\x{{0331}}]', '', 'g')"


def norm(x: str) -> str:
    return f"lower(trim(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), '()'))"


def terms(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '{TERM}')"


PARTS: dict[str, str] = {
    "ids": f"SELECT DISTINCT chunk_id, {norm('ident')} AS ident, role FROM idents WHERE {norm('ident')} <> ''",
    "placed": "SELECT c.id AS chunk_id, c.file_id, f.source_id, s.name AS source, f.path, f.type, f.lang, s.kind AS source_kind, s.public, c.start_line, c.end_line, c.kind, c.heading_path, c.parent_id, c.text FROM chunks c JOIN files f ON f.id = c.file_id JOIN sources s ON s.id = f.source_id",
    "meta": "SELECT f.id AS file_id, key, value FROM (SELECT source_id, path, e.key AS key, unnest(e.value) AS value FROM (SELECT source_id, path, unnest(map_entries(meta)) AS e FROM mirror_items)) m JOIN files f USING (source_id, path) WHERE value <> ''",
    "firsts": "SELECT file_id, arg_min(id, (start_line, id)) AS first_chunk FROM chunks GROUP BY 1",
    "anchored": "SELECT file_id, anchor, arg_min(id, (start_line, id)) AS anchored_chunk FROM chunks WHERE anchor <> '' GROUP BY 1, 2",
    "refs": """SELECT c.id AS chunk_id, f.path AS target_path, p.anchor AS target_anchor FROM chunks c JOIN chunks p ON p.id = c.parent_id JOIN files f ON f.id = p.file_id
        UNION ALL SELECT first_chunk, n.url, '' FROM (SELECT source_id, path, lead(url) OVER (PARTITION BY source_id ORDER BY item_id) AS url FROM mirror_items) n
        JOIN files f USING (source_id, path) JOIN firsts ON firsts.file_id = f.id WHERE n.url <> ''""",
    "cited": """SELECT DISTINCT r.chunk_id AS src, coalesce(a.anchored_chunk, fi.first_chunk) AS dst, r.target_path || CASE WHEN r.target_anchor <> '' THEN '#' || r.target_anchor ELSE '' END AS via
        FROM refs r JOIN chunks c ON c.id = r.chunk_id JOIN files f ON f.id = c.file_id JOIN files f2 ON f2.source_id = f.source_id AND f2.path = r.target_path
        LEFT JOIN anchored a ON a.file_id = f2.id AND a.anchor = lower(r.target_anchor) LEFT JOIN firsts fi ON fi.file_id = f2.id
        WHERE coalesce(a.anchored_chunk, fi.first_chunk) <> r.chunk_id""",
    "items": "SELECT rtrim(m.url, '/') AS url, min(f.id) AS file_id FROM mirror_items m JOIN sources s ON s.id = m.source_id AND s.kind <> 'dir' JOIN files f USING (source_id, path) WHERE m.url <> '' GROUP BY 1",
    "addressed": "SELECT DISTINCT r.chunk_id AS src, fi.first_chunk AS dst, r.target_path AS via FROM refs r JOIN items i ON i.url = rtrim(r.target_path, '/') JOIN firsts fi ON fi.file_id = i.file_id WHERE r.target_path LIKE 'http%' AND fi.first_chunk <> r.chunk_id",
    "few": "SELECT ident FROM ids WHERE role = 'defines' GROUP BY 1 HAVING count(*) <= 3",
    "defined": "SELECT DISTINCT m.chunk_id AS src, d.chunk_id AS dst, m.ident AS via FROM ids m JOIN few USING (ident) JOIN ids d ON d.ident = m.ident AND d.role = 'defines' WHERE m.role = 'mentions' AND m.chunk_id <> d.chunk_id",
    "loose": "SELECT i.ident, i.chunk_id, c.file_id FROM ids i JOIN chunks c ON c.id = i.chunk_id WHERE i.role = 'mentions' AND regexp_matches(i.ident, '[_./-]') AND i.ident NOT IN (SELECT ident FROM ids WHERE role = 'defines')",
    "loose_rare": "SELECT ident FROM loose GROUP BY 1 HAVING count(DISTINCT chunk_id) BETWEEN 2 AND 5 AND count(DISTINCT file_id) >= 2",
    "shared": "SELECT DISTINCT a.chunk_id AS src, b.chunk_id AS dst, ident AS via FROM loose a JOIN loose_rare USING (ident) JOIN loose b USING (ident) WHERE a.file_id <> b.file_id",
    "prose": "SELECT i.ident, i.chunk_id, c.file_id FROM ids i JOIN few USING (ident) JOIN chunks c ON c.id = i.chunk_id JOIN files f ON f.id = c.file_id WHERE i.role = 'mentions' AND f.lang IN ('markdown', 'text')",
    "prose_rare": "SELECT ident FROM prose GROUP BY 1 HAVING count(DISTINCT chunk_id) BETWEEN 2 AND 5 AND count(DISTINCT file_id) >= 2",
    "told": "SELECT DISTINCT a.chunk_id AS src, b.chunk_id AS dst, ident AS via FROM prose a JOIN prose_rare USING (ident) JOIN prose b USING (ident) WHERE a.file_id <> b.file_id",
    "links": """SELECT src, dst, rel, arg_min(via, (o, via)) AS via FROM (SELECT src, dst, 'citation' AS rel, 0 AS o, via FROM cited UNION ALL SELECT src, dst, 'citation', 1, via FROM addressed
        UNION ALL SELECT src, dst, 'mentions', 2, via FROM defined UNION ALL SELECT src, dst, 'mentions', 3, via FROM shared UNION ALL SELECT src, dst, 'mentions', 4, via FROM told) GROUP BY 1, 2, 3""",
    "both_ways": "SELECT src AS me, dst AS other, rel, via, 'out' AS dir FROM links UNION ALL SELECT dst, src, rel, via, 'in' FROM links",
    "tok": f"SELECT c.id AS chunk_id, {terms(chr(39) + chr(39) + ' || translate(f.path || chr(32) || c.heading_path, chr(47) || chr(95) || chr(45), repeat(chr(32), 3))')} AS h, {terms('c.text')} AS b FROM chunks c JOIN files f ON f.id = c.file_id",
    "occ": "SELECT chunk_id, 'head' AS col, unnest(h) AS term, generate_subscripts(h, 1) - 1 AS pos FROM tok UNION ALL SELECT chunk_id, 'body', unnest(b), generate_subscripts(b, 1) - 1 FROM tok",
    "lens": "SELECT chunk_id, len(h) + len(b) AS len, len(h) AS head_len FROM tok",
    "stats": "SELECT count(*) AS n, sum(len) / count(*) AS avg_len FROM lens",
    "asked": "SELECT item_id AS query_id, question AS text FROM bench_items",
    "known": "SELECT c.id AS query_id, list_extract(string_split(c.heading_path, ' > '), -1) AS text FROM chunks c WHERE c.id % 20 = 0 AND c.heading_path <> ''",
    "gold": "SELECT chunk_id AS query_id, chunk_id, source, path, start_line, end_line FROM placed WHERE chunk_id IN (SELECT query_id FROM known)",
}


# The same where the first chunk that mentions a name with a sign in it also defines it.
PARTS["ids2"] = "SELECT * FROM ids UNION ALL SELECT min(chunk_id), ident, 'defines' FROM ids WHERE role = 'mentions' AND regexp_matches(ident, '[_./-]') GROUP BY 2"
for _name in ("few", "defined", "prose", "prose_rare", "told"):
    PARTS[f"{_name}2"] = re.sub(r"\b(ids|few|prose|prose_rare)\b(?=[ )]|$)", r"\g<1>2", PARTS[_name])


def _bm25(name: str, asked: str, phrases: bool = False, weight: float = 1.0, words: str | None = None) -> None:
    """Parts `<name>_ph` (query_id, phrase, t) and `<name>` (query_id, chunk_id, score)."""
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])" if phrases else "[]"
    PARTS[f"{name}_ph"] = words or (
        f"SELECT query_id, array_to_string(t, ' ') AS phrase, t FROM (SELECT query_id, {terms('s')} AS t FROM (SELECT query_id, unnest(list_distinct(list_concat(list_filter(w, lambda x: length(x) > 1), {pairs}))) AS s "
        f"FROM (SELECT query_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM {asked}))) WHERE len(t) > 0"
    )
    PARTS[f"{name}_pt"] = f"SELECT phrase, len(t) AS n, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS i FROM (SELECT DISTINCT phrase, t FROM {name}_ph)"
    PARTS[f"{name}_at"] = f"SELECT phrase, chunk_id, col FROM occ JOIN {name}_pt USING (term) GROUP BY phrase, n, chunk_id, col, pos - i HAVING count(*) = n"
    PARTS[f"{name}_f"] = f"SELECT phrase, chunk_id, sum(CASE WHEN col = 'head' THEN {weight} ELSE 1.0 END) AS f FROM {name}_at GROUP BY 1, 2"
    PARTS[f"{name}_w"] = f"SELECT phrase, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 0) AS raw FROM {name}_f, stats GROUP BY phrase, n"
    PARTS[name] = (
        f"SELECT query_id, chunk_id, round(sum(CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score "
        f"FROM {name}_ph JOIN {name}_f USING (phrase) JOIN {name}_w USING (phrase) JOIN lens USING (chunk_id), stats GROUP BY 1, 2"
    )
    PARTS[f"{name}_top"] = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS seq FROM {name}"


_bm25("bm", "asked")
_bm25("bp", "asked", phrases=True, weight=2.0)
_bm25("kn", "known")
_bm25("k3", "known", weight=3.0)
PARTS["pool"] = "SELECT query_id, chunk_id, seq FROM bm_top WHERE seq <= 15"
PARTS["seedpool"] = "SELECT query_id, chunk_id, seq FROM bm_top WHERE seq <= 5"
PARTS["krun"] = "SELECT t.query_id, t.chunk_id, t.seq, p.source, p.path, p.start_line, p.end_line FROM kn_top t JOIN placed p USING (chunk_id) WHERE seq <= 30"
PARTS["kranks"] = "SELECT g.query_id, min(r.seq) AS rank FROM gold g LEFT JOIN krun r ON r.query_id = g.query_id AND r.source = g.source AND r.path = g.path AND r.end_line >= g.start_line AND r.start_line <= g.end_line GROUP BY 1"
PARTS["krun3"] = "SELECT t.query_id, t.seq, p.source, p.path, p.start_line, p.end_line FROM k3_top t JOIN placed p USING (chunk_id) WHERE seq <= 30"
PARTS["kranks3"] = PARTS["kranks"].replace("krun r", "krun3 r")

# Categories by cue words.
_CUES = {
    "Rule": "must|may|policy|limit|threshold|approves?|rejects?",
    "Procedure": "when|if|run|retry|write|block|step|schedule",
    "Reference": "table|column|field|schema|index|definition|null",
    "Explanation": "because|since|why|reason|despite",
    "Finding": "counts?|measures?|scores?|compares?|ranks?",
    "Record": "status|comment|report|was|were|open|done",
    "Other": "summary|list|label",
}
_COUNTS = ", ".join(rf"{{'category': '{c}', 'o': {i}, 'n': len(regexp_extract_all(lower(body), '\b(?:{cue})\b')) + 1}}" for i, (c, cue) in enumerate(_CUES.items()))
_SPREAD = f"SELECT key, u.category AS category, u.o AS o, round(u.n / sum(u.n) OVER (PARTITION BY key), 6) AS p FROM (SELECT key, unnest([{_COUNTS}]) AS u FROM {{rows}})"
PARTS["prose_rows"] = "SELECT chunk_id, file_id, source_id, type, '[' || path || CASE WHEN heading_path <> '' THEN ' > ' || heading_path ELSE '' END || ']' || chr(10) || text AS body, text FROM placed WHERE lang IN ('markdown', 'text') OR type = 'Dataset'"
PARTS["cat_rows"] = "SELECT chunk_id AS key, body FROM prose_rows WHERE coalesce(type, '') <> 'Dataset'"
PARTS["cat_p"] = _SPREAD.replace("{rows}", "cat_rows")
PARTS["cats"] = (
    "SELECT key AS chunk_id, category, p, category = arg_max(category, (p, -o)) OVER (PARTITION BY key) AND category <> 'Other' AS kept, 'cues' AS model FROM cat_p "
    "UNION ALL SELECT chunk_id, category, CASE WHEN category = 'Reference' THEN 1.0 ELSE 0.0 END, category = 'Reference', 'code' FROM prose_rows, (SELECT unnest([" + ", ".join(f"'{c}'" for c in fixed.CATEGORIES) + "]) AS category) WHERE type = 'Dataset'"
)
PARTS["q_rows"] = "SELECT query_id AS key, text AS body FROM asked"
PARTS["q_p"] = _SPREAD.replace("{rows}", "q_rows")
PARTS["q_cats"] = "SELECT key AS query_id, category FROM (SELECT key, arg_max(category, (p, -o)) AS category FROM q_p GROUP BY 1) WHERE category <> 'Other'"
PARTS["judged"] = "SELECT chunk_id, category AS said, CASE WHEN chunk_id % 7 = 0 THEN 'Other' ELSE category END AS gold, p, chunk_id % 7 <> 0 AS ok, chunk_id % 3 AS stratum FROM cats WHERE kept AND model <> 'code'"

# Changes between snapshots.
PARTS["newest"] = "SELECT source_id, arg_max(run_id, (coalesce(started_at, TIMESTAMP '0001-01-01'), run_id)) AS run_id FROM sync_runs GROUP BY 1"
PARTS["scan"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, path ORDER BY seen_at DESC NULLS LAST, lang DESC NULLS LAST, size DESC NULLS LAST, mtime_ns DESC NULLS LAST, sha1 DESC NULLS LAST) AS rn FROM file_scans SEMI JOIN newest USING (source_id, run_id)) WHERE rn = 1"
PARTS["listing"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, item_id ORDER BY listed_at DESC NULLS LAST, version DESC NULLS LAST, path DESC NULLS LAST, url DESC NULLS LAST) AS rn FROM remote_listing SEMI JOIN newest USING (source_id, run_id)) WHERE rn = 1"
_TEST = "list_has_any(regexp_split_to_array(lower(path), '[/_\\-.]'), [" + ", ".join(f"'{w}'" for w in fixed.TEST_WORDS) + "]) OR regexp_matches(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), '(Tests?|Spec)$')"
_TYPE = f"CASE WHEN lang IN ('markdown', 'pdf', 'text') THEN 'Article' WHEN lang = 'data' THEN 'Dataset' WHEN lang IN ('ini', 'json', 'toml', 'yaml') THEN 'Configuration' WHEN {_TEST} THEN 'Test' ELSE 'SoftwareSourceCode' END"
PARTS["file_status"] = f"""SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
         WHEN n.lang IS NOT DISTINCT FROM o.lang AND n.size IS NOT DISTINCT FROM o.size AND n.mtime_ns IS NOT DISTINCT FROM o.mtime_ns THEN 'unchanged'
         WHEN n.lang IS NOT DISTINCT FROM o.lang AND n.sha1 = o.sha1 THEN 'restamped' ELSE 'changed' END AS status,
    o.path IS NOT NULL AND n.path IS NOT NULL AND n.type IS DISTINCT FROM o.type AS retyped
    FROM (SELECT source_id, path, lang, {_TYPE} AS type, size, mtime_ns, sha1 FROM scan) n FULL JOIN files o ON n.source_id = o.source_id AND n.path = o.path"""
PARTS["sections"] = r"""SELECT file_id, i, line, regexp_matches(line, '^\s*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) % 2 AS inside
    FROM (SELECT file_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT t.file_id, string_split(t.text, chr(10)) AS lines FROM file_texts t JOIN files f ON f.id = t.file_id WHERE f.lang = 'markdown' AND trim(t.text) <> ''))"""
PARTS["heads"] = r"SELECT file_id, i, length(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*\s*$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*\s*$', 2)) AS title FROM sections WHERE NOT fence AND inside = 0 AND regexp_matches(line, '^#{1,6}\s+(.*?)\s*#*\s*$')"

PARTS["head_paths"] = "SELECT h.file_id, h.i, h.title, string_agg(a.title, ' > ' ORDER BY a.i) AS heading_path FROM heads h JOIN heads a ON a.file_id = h.file_id AND a.i <= h.i AND NOT EXISTS (SELECT 1 FROM heads k WHERE k.file_id = a.file_id AND k.i > a.i AND k.i <= h.i AND k.level <= a.level) GROUP BY 1, 2, 3"
PARTS["all_heads"] = "SELECT file_id, i, title, heading_path FROM head_paths UNION ALL SELECT DISTINCT file_id, 0, '', '' FROM sections"
PARTS["bounds"] = "SELECT *, lead(i, 1, 1000000000) OVER (PARTITION BY file_id ORDER BY i) AS following FROM all_heads"
PARTS["section_rows"] = rf"SELECT b.file_id, b.heading_path, regexp_replace(regexp_replace(lower(trim(b.title)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '-', 'g') AS anchor, min(l.i) AS s, max(l.i) AS e FROM bounds b JOIN sections l ON l.file_id = b.file_id AND l.i >= b.i AND l.i < b.following AND regexp_matches(l.line, '[^{SPACE}]') GROUP BY b.file_id, b.i, b.heading_path, b.title HAVING count(*) FILTER (l.i > b.i) > 0"


def sql(select: str) -> str:
    """The statement with every part it names, directly or through other parts."""
    need: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", body):
            if name in PARTS and name not in need and name not in busy:
                busy.add(name)
                visit(PARTS[name])
                need.append(name)

    busy: set[str] = set()
    visit(select)
    return ("WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in need) + "\n" if need else "") + select


_SCOPE_WHERE = {
    "kind:jira,github status:Done": "source_kind IN ('jira', 'github') AND file_id IN (SELECT file_id FROM meta WHERE key = 'status' AND lower(value) = 'done')",
    "-status:Done": "file_id NOT IN (SELECT file_id FROM meta WHERE key = 'status' AND lower(value) = 'done')",
    "path:docs/* lang:markdown": "lower(path) LIKE 'docs/%' AND lang = 'markdown'",
    "labels:index -type:Dataset": "file_id IN (SELECT file_id FROM meta WHERE key = 'labels' AND lower(value) = 'index') AND coalesce(type, '') <> 'Dataset'",
    "status:>=O": "file_id IN (SELECT file_id FROM meta WHERE key = 'status' AND value >= 'O')",
    "source:ops-wiki,ops-api": "source IN ('ops-wiki', 'ops-api')",
    "kind:dir -lang:python,sql": "source_kind = 'dir' AND lang NOT IN ('python', 'sql')",
    "category:Rule -kind:dir": "chunk_id IN (SELECT chunk_id FROM cats WHERE kept AND category = 'Rule') AND source_kind <> 'dir'",
}
_SCOPES = " UNION ALL ".join(f"SELECT '{s}' AS scope, chunk_id FROM placed WHERE {w}" for s, w in _SCOPE_WHERE.items())
PARTS["targets"] = "SELECT source || ':' || path || ':' || (start_line + 1) || '-' || (end_line + 2) AS target, source, path, file_id, start_line + 1 AS s, end_line + 2 AS e FROM placed WHERE chunk_id % 20 = 0"
PARTS["shown"] = "SELECT t.target, p.chunk_id, p.file_id, p.parent_id, p.start_line, t.s, t.e FROM (SELECT DISTINCT * FROM targets) t JOIN placed p ON p.source = t.source AND p.path = t.path AND p.end_line >= t.s AND p.start_line <= t.e"
PARTS["away"] = "SELECT s.target, b.rel, b.other, b.dir, b.via FROM shown s JOIN both_ways b ON b.me = s.chunk_id WHERE NOT EXISTS (SELECT 1 FROM shown x WHERE x.target = s.target AND x.chunk_id = b.other)"
PARTS["head_shown"] = "SELECT target, arg_min(parent_id, (start_line, chunk_id)) AS parent_id, any_value(file_id) AS file_id, any_value(s) AS s, any_value(e) AS e FROM shown GROUP BY 1"
PARTS["seed_chunks"] = "SELECT id AS query_id, text, file_id FROM chunks WHERE id % 20 = 0"
PARTS["seed_words"] = f"SELECT query_id, {fold('w')} AS term, count(*) AS tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM seed_chunks) WHERE length(w) > 1 AND w NOT LIKE '%\\_%' ESCAPE '\\' GROUP BY 1, 2"
PARTS["body_df"] = "SELECT term, count(DISTINCT chunk_id) AS df FROM occ WHERE col = 'body' GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 2"
PARTS["weighed"] = "SELECT query_id, term, round(tf * ln(n / df), 9) AS weight FROM seed_words JOIN body_df USING (term), stats"
PARTS["best_words"] = "SELECT query_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS k FROM weighed) WHERE k <= 24"
_bm25("nb", "", words="SELECT query_id, term AS phrase, [term] AS t FROM best_words")
PARTS["near"] = "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank FROM (SELECT t.query_id, t.chunk_id, t.seq FROM nb_top t JOIN chunks c ON c.id = t.chunk_id JOIN seed_chunks s ON s.query_id = t.query_id WHERE t.seq <= 50 AND c.file_id <> s.file_id) QUALIFY rank <= 10"
_SHAPES = [r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b", r"\b[A-Z][A-Z0-9]+-\d+\b", r"\b[a-z0-9_]+\.[a-z0-9_]+\.[a-z0-9_]+\b", r"\b[\p{L}\p{N}_.\-]+/[\p{L}\p{N}_.\-]+#\d+\b"]
_FOUND = ", ".join(f"regexp_extract_all(text, '{s}')" for s in _SHAPES)
_QUOTED = r"""regexp_extract_all(text, '["'']([A-Za-z_][\p{L}\p{N}_\-]*(?:[.\-][\p{L}\p{N}_\-]+)+)["'']', 1)"""
_TICKS = r"list_filter(list_transform(regexp_extract_all(text, '`([^`\n]{2,80})`', 1), lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-Za-z_@][\p{L}\p{N}_.\-/:@]*$') AND length(x) >= 3)"
_NDCG = "CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END"
_THRESHOLDS = "(SELECT unnest([" + ", ".join(f"{0.05 * i:.2f}" for i in range(20)) + "])::DOUBLE AS threshold)"
PARTS["curve"] = f"SELECT said AS class, threshold, count(*) AS n, count(*) FILTER (p >= threshold) AS kept, round(count(*) FILTER (p >= threshold AND said = gold) / nullif(count(*) FILTER (p >= threshold), 0), 3) AS precision, count(*) FILTER (stratum = 0) AS ood_n, count(*) FILTER (stratum = 0 AND p >= threshold) AS ood_kept, round(count(*) FILTER (stratum = 0 AND p >= threshold AND said = gold) / nullif(count(*) FILTER (stratum = 0 AND p >= threshold), 0), 3) AS ood_precision FROM judged, {_THRESHOLDS} GROUP BY 1, 2"
_CURVE_AT = "(SELECT unnest([" + ", ".join(f"{0.05 * i:.2f}" for i in range(1, 20)) + "])::DOUBLE AS threshold)"
PARTS["answers_curve"] = f"SELECT threshold, round(k, 3) AS keeps_answerable, round(f, 3) AS flags_absent, round((k + f) / 2, 3) AS balanced FROM (SELECT threshold, count(*) FILTER (p >= threshold AND ok) / nullif(count(*) FILTER (ok), 0) AS k, count(*) FILTER (p < threshold AND NOT ok) / nullif(count(*) FILTER (NOT ok), 0) AS f FROM judged, {_CURVE_AT} GROUP BY 1)"
PARTS["answers"] = "SELECT q.id AS query_id, c.id AS chunk_id FROM chunks q JOIN chunks c ON c.file_id = q.file_id WHERE q.id % 20 = 0 AND q.heading_path <> ''"
PARTS["swapped"] = """SELECT query_id, seq, chunk_id FROM krun r WHERE seq <= 10 AND NOT EXISTS (SELECT 1 FROM answers a WHERE a.query_id = r.query_id AND a.chunk_id = r.chunk_id)
UNION ALL SELECT s.query_id, s.seq, f.chunk_id FROM (SELECT query_id, seq, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS k FROM krun r WHERE seq <= 10 AND EXISTS (SELECT 1 FROM answers a WHERE a.query_id = r.query_id AND a.chunk_id = r.chunk_id)) s
JOIN (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS k FROM krun r WHERE seq > 10 AND NOT EXISTS (SELECT 1 FROM answers a WHERE a.query_id = r.query_id AND a.chunk_id = r.chunk_id)) f ON f.query_id = s.query_id AND f.k = s.k"""
PARTS["run_docs"] = "SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY seq, doc) AS rank FROM (SELECT query_id, source || ':' || path AS doc, min(seq) AS seq FROM krun GROUP BY 1, 2)"
PARTS["qrels2"] = "SELECT g.query_id, s.name || ':' || f.path AS doc, CASE WHEN f.path = g.path THEN 2 ELSE 1 END AS gain FROM gold g JOIN sources s ON s.name = g.source JOIN files f ON f.source_id = s.id"
PARTS["type_p"] = "SELECT query_id, type, CASE WHEN (query_id + i) % 3 = 0 THEN 0.4 ELSE 0.1 END AS p FROM (SELECT query_id, unnest(['Article', 'SoftwareSourceCode', 'Configuration', 'Dataset']) AS type, unnest([0, 1, 2, 3]) AS i FROM asked)"
PARTS["type_chosen"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, type) AS place FROM type_p) WHERE p >= 0.25 OR place = 1"
PARTS["typed"] = "SELECT b.query_id, b.chunk_id, t.type, t.place, row_number() OVER (PARTITION BY b.query_id, t.type ORDER BY score DESC, b.chunk_id) AS bm25_rank FROM bm b JOIN placed p USING (chunk_id) JOIN type_chosen t ON t.query_id = b.query_id AND t.type = p.type"
PARTS["about"] = "SELECT DISTINCT q.query_id, c.chunk_id FROM cats c JOIN q_cats q USING (category) WHERE c.kept"
PARTS["in_about"] = "SELECT b.query_id, b.chunk_id, row_number() OVER (PARTITION BY b.query_id ORDER BY score DESC, b.chunk_id) AS r FROM bm b JOIN about USING (query_id, chunk_id)"
PARTS["doc_tok"] = PARTS["tok"].replace("c.id AS chunk_id", "doc_id AS chunk_id").replace("f.path || chr(32) || c.heading_path", "concat_ws(chr(32), path, source)").replace("c.text", "coalesce(text, '')").replace("chunks c JOIN files f ON f.id = c.file_id", "documents")
PARTS["w1_q"] = "SELECT id AS query_id, 'what does ' || path || ' say of snapshot and payout' AS text FROM files WHERE id % 20 = 0"

def _names(rows: str) -> str:
    """(query_id, name): names of the texts of `rows` (query_id, text), and parts of dotted ones."""
    return f"SELECT DISTINCT query_id, unnest(list_concat([w], list_filter(regexp_split_to_array(w, '[./:]'), lambda x: length(x) >= 3))) AS name FROM (SELECT query_id, {norm('w')} AS w FROM (SELECT query_id, unnest(list_concat({_FOUND}, {_TICKS}, list_filter({_QUOTED}, lambda x: length(x) <= 80))) AS w FROM {rows}))"


PARTS["chunk_names"] = _names("seed_chunks")
PARTS["q_names"] = _names("asked")
PARTS["q_named"] = "SELECT query_id, chunk_id, via, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, via, chunk_id) AS seq FROM (SELECT q.query_id, i.chunk_id, max(length(q.name)) AS n, 'defines:' || arg_max(q.name, (length(q.name), q.name)) AS via FROM q_names q JOIN few ON few.ident = q.name JOIN ids i ON i.ident = q.name AND i.role = 'defines' WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = q.query_id AND p.chunk_id = i.chunk_id) GROUP BY 1, 2)"
PARTS["any_lines"] = PARTS["sections"].replace(" JOIN files f ON f.id = t.file_id WHERE f.lang = 'markdown' AND trim(t.text) <> ''", "")
PARTS["any_heads"] = PARTS["heads"].replace("FROM sections", "FROM any_lines")
PARTS["frag"] = "SELECT c.id AS query_id, c.file_id, regexp_replace(lower(list_extract(string_split(c.heading_path, ' > '), -1)), '[^\\p{L}\\p{N}]+', '', 'g') AS name, len(string_split(t.text, chr(10))) AS size FROM chunks c JOIN file_texts t USING (file_id) WHERE c.id % 20 = 0 AND c.heading_path <> ''"
PARTS["frag_hit"] = "SELECT f.query_id, h.i, h.level FROM frag f JOIN any_heads h ON h.file_id = f.file_id AND regexp_replace(lower(h.title), '[^\\p{L}\\p{N}]+', '', 'g') = f.name"
PARTS["seed3_chunks"] = "SELECT DISTINCT c.id AS query_id, c.text, c.file_id FROM chunks c JOIN kn_top k ON k.chunk_id = c.id WHERE k.seq <= 3"
for _part in ("seed_words", "weighed", "best_words"):
    PARTS[_part.replace("seed", "seed3").replace("weighed", "weighed3").replace("best", "best3")] = PARTS[_part].replace("seed_chunks", "seed3_chunks").replace("seed_words", "seed3_words").replace("weighed", "weighed3")
_bm25("n3", "", words="SELECT query_id, term AS phrase, [term] AS t FROM best3_words")
PARTS["near3"] = PARTS["near"].replace("nb_top", "n3_top").replace("seed_chunks", "seed3_chunks")

ORACLE: dict[str, str] = {
    "f19_document_types": f"""SELECT DISTINCT path, suffix_lang, lang, {_TYPE} AS type FROM (SELECT path, suffix_lang, CASE WHEN suffix_lang IN ({", ".join(f"'{x}'" for x in fixed.CUT_BY_GRAMMAR)}) THEN 'code' ELSE suffix_lang END AS lang
        FROM (SELECT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGE_OF_SUFFIX.items())} END AS suffix_lang FROM file_scans))""",
    "c07_names": f"SELECT DISTINCT chunk_id, {norm('name')} AS name FROM (SELECT id AS chunk_id, unnest(list_concat({_FOUND}, {_TICKS}, list_filter({_QUOTED}, lambda x: length(x) <= 80))) AS name FROM chunks)",
    "c10_slugs": r"SELECT id AS chunk_id, regexp_replace(regexp_replace(lower(trim(list_extract(string_split(heading_path, ' > '), -1))), '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', '-', 'g') AS slug FROM chunks",
    "f21_snippets": "SELECT id AS chunk_id, CASE WHEN length(s) > 160 THEN s[:160] || '…' ELSE s END AS snippet FROM (SELECT id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '<!--')), ' ') AS s FROM chunks)",
    "s11_sizes": "SELECT id AS file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576) WHEN size < 1099511627776 THEN printf('%.1f GB', size / 1073741824) ELSE printf('%.1f TB', size / 1099511627776) END AS size FROM files",
    "s10_defined_names": sql("SELECT DISTINCT t.file_id, i.ident AS name FROM file_texts t JOIN chunks c ON c.file_id = t.file_id JOIN ids i ON i.chunk_id = c.id AND i.role = 'defines' WHERE NOT regexp_matches(i.ident, '\\s') AND i.ident NOT LIKE '%-->%'"),
    "b03_terms": f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "b04_vocabulary": sql("SELECT term, col, count(DISTINCT chunk_id) AS docs, count(*) AS occurrences FROM occ GROUP BY 1, 2"),
    "b00_index": sql("SELECT chunk_id, CAST(len AS INTEGER) AS len, term, CAST(count(*) FILTER (col = 'head') AS INTEGER) AS head_tf, CAST(count(*) FILTER (col = 'body') AS INTEGER) AS body_tf, string_agg(CAST(CASE WHEN col = 'head' THEN pos ELSE head_len + 1 + pos END AS VARCHAR), ',' ORDER BY CASE WHEN col = 'head' THEN pos ELSE head_len + 1 + pos END) AS positions FROM occ JOIN lens USING (chunk_id) GROUP BY chunk_id, len, term"),
    "b01_query_phrases": sql("SELECT query_id, phrase FROM bp_ph"),
    "b02_bm25": sql("SELECT query_id, chunk_id, round(score, 6) AS score, CAST(seq AS INTEGER) AS bm25_rank FROM bm_top WHERE seq <= 15"),
    "b02_bm25_phrases": sql("SELECT query_id, chunk_id, round(score, 6) AS score, CAST(seq AS INTEGER) AS bm25_rank FROM bp_top WHERE seq <= 15"),
    "b02_bm25_scoped": sql("SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS bm25_rank FROM bm JOIN placed USING (chunk_id) WHERE type = 'Article' AND source NOT LIKE 'ops-%') WHERE bm25_rank <= 15"),
    "b02_bm25_documents": re.sub(r"\btok AS \(.*\),\nocc AS", lambda m: f"tok AS ({PARTS['doc_tok']}),\nocc AS", sql("SELECT query_id, chunk_id AS doc_id, round(score, 6) AS score, CAST(seq AS INTEGER) AS bm25_rank FROM bm_top WHERE seq <= 15")),
    "f03_scopes": sql(_SCOPES),
    "f08_scope_files": sql("SELECT DISTINCT file_id FROM placed WHERE chunk_id IN (SELECT chunk_id FROM cats WHERE kept AND category IN ('Rule', 'Record'))"),
    "f10_scope_counts": sql(f"SELECT scope, count(chunk_id) AS chunks FROM (SELECT unnest([{', '.join(repr(s) for s in _SCOPE_WHERE)}]) AS scope) LEFT JOIN ({_SCOPES}) USING (scope) GROUP BY 1"),
    "f12_scope_types": "SELECT DISTINCT f.type FROM files f JOIN sources s ON s.id = f.source_id WHERE s.kind = 'dir' AND f.type IS NOT NULL",
    "f13_grep_lines": r"SELECT source, path, CAST(i AS INTEGER) AS line, rtrim(line) AS text FROM (SELECT s.name AS source, f.path, unnest(string_split(t.text, chr(10))) AS line, generate_subscripts(string_split(t.text, chr(10)), 1) AS i FROM file_texts t JOIN files f ON f.id = t.file_id JOIN sources s ON s.id = f.source_id) WHERE regexp_matches(line, 'map_config\(|[Ss]napshot rarely')",
    "f13_grep_totals": "SELECT count(*) AS total, count(DISTINCT file_id) AS files FROM (SELECT t.file_id, unnest(string_split(t.text, chr(10))) AS line FROM file_texts t) WHERE regexp_matches(line, '(?i)PAYOUT')",
    "f14_folders": sql(" UNION ALL ".join(
        f"SELECT '{s}:{p}' AS target, name, CASE WHEN name LIKE '%/' THEN count(*) ELSE 0 END AS files, CAST(sum(n) AS BIGINT) AS chunks FROM (SELECT CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) || '/' ELSE rest END AS name, n FROM (SELECT f.path[{len(under) + 1}:] AS rest, count(c.id) AS n FROM files f JOIN sources s ON s.id = f.source_id LEFT JOIN chunks c ON c.file_id = f.id WHERE s.name = '{s}' AND starts_with(f.path, '{under}') GROUP BY f.id, f.path)) GROUP BY name"
        for s, p, under in (("ops-api", "", ""), ("ops-api", "lib", "lib/"), ("billing-docs", "docs/", "docs/")))),
    "f15_sources": "SELECT s.name, s.kind, s.public, count(DISTINCT f.id) AS files, count(c.id) AS chunks FROM sources s LEFT JOIN files f ON f.source_id = s.id LEFT JOIN chunks c ON c.file_id = f.id GROUP BY s.id, s.name, s.kind, s.public",
    "f16_read": sql("SELECT t.target, t.source, t.path, CAST(t.s AS INTEGER) AS start_line, CAST(least(t.e, len(lines)) AS INTEGER) AS end_line, (SELECT arg_max(heading_path, (start_line, id)) FROM chunks c WHERE c.file_id = t.file_id AND c.start_line <= t.s) AS heading_path, array_to_string(lines[t.s:least(t.e, len(lines))], chr(10)) AS text FROM targets t JOIN (SELECT file_id, string_split(text, chr(10)) AS lines FROM file_texts) x ON x.file_id = t.file_id"),
    "f17_read_urls": "SELECT m.url AS target, s.name AS source, m.path, CAST(1 AS INTEGER) AS start_line, CAST(len(string_split(t.text, chr(10))) AS INTEGER) AS end_line, t.text FROM mirror_items m JOIN sources s ON s.id = m.source_id JOIN files f USING (source_id, path) JOIN file_texts t ON t.file_id = f.id WHERE m.url <> ''",
    "f24_type_groups": sql("SELECT query_id, chunk_id, CAST(seq AS INTEGER) AS seq, type, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS INTEGER) AS group_place FROM (SELECT p.query_id, p.chunk_id, p.seq, x.type, min(p.seq) OVER (PARTITION BY p.query_id, coalesce(x.type, '(untyped)')) AS best FROM pool p JOIN placed x USING (chunk_id))"),
    "j15_around": "SELECT id AS chunk_id, coalesce(lag(id) OVER w, 0) AS before, coalesce(lead(id) OVER w, 0) AS after FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY start_line, id)",
    "j17_overlaps": sql("SELECT target, chunk_id FROM shown"),
    "l07_shown_links": sql("SELECT target, CASE WHEN max(n) > 1 THEN 'both' ELSE min(d) END AS dir, rel, CASE WHEN max(n) > 1 THEN string_agg(via, ', ' ORDER BY d DESC, via) ELSE arg_min(via, (d = 'in', via)) END AS via, other FROM (SELECT target, rel, other, via, max(dir) AS d, max(n) AS n FROM (SELECT *, (SELECT count(DISTINCT y.dir) FROM away y WHERE y.target = x.target AND y.rel = x.rel AND y.other = x.other) AS n FROM away x) GROUP BY 1, 2, 3, 4) GROUP BY target, rel, other"),
    "x03_shown_structure": sql("SELECT h.target, 'parent' AS rel, h.parent_id AS other FROM head_shown h WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.target = h.target AND s.chunk_id = h.parent_id) UNION ALL SELECT h.target, 'before', arg_max(c.id, (c.start_line, c.id)) FROM head_shown h JOIN chunks c ON c.file_id = h.file_id AND c.end_line < h.s GROUP BY 1 UNION ALL SELECT h.target, 'after', arg_min(c.id, (c.start_line, c.id)) FROM head_shown h JOIN chunks c ON c.file_id = h.file_id AND c.start_line > h.e GROUP BY 1"),
    "x03_shown_names": sql("SELECT s.target, s.chunk_id, coalesce(string_agg(DISTINCT i.ident, ' ' ORDER BY i.ident) FILTER (i.role = 'defines'), '') AS defines, CAST(count(DISTINCT i.ident) FILTER (i.role = 'mentions') AS INTEGER) AS mentions FROM shown s LEFT JOIN ids i USING (chunk_id) GROUP BY 1, 2"),
    "j03_citations": sql("SELECT * FROM cited"),
    "j04_definitions": sql("SELECT * FROM defined2"),
    "j05_shared_names": sql("SELECT * FROM shared"),
    "j06_prose_mentions": sql("SELECT * FROM told2"),
    "j07_url_citations": sql("SELECT * FROM addressed"),
    "l01_links": sql("SELECT * FROM links"),
    "l03_link_counts": sql("SELECT rel, count(*) AS links FROM links GROUP BY 1"),
    "l05_chunk_kinds": sql("SELECT p.chunk_id, CASE p.type WHEN 'Configuration' THEN 'config' WHEN 'Dataset' THEN 'table' WHEN 'SoftwareSourceCode' THEN 'code' WHEN 'Test' THEN 'test' ELSE CASE WHEN category = 'Procedure' AND p2 >= 0.8 THEN 'steps' WHEN category = 'Record' AND p2 >= 0.7 THEN 'record' WHEN category = 'Finding' AND p2 >= 0.8 THEN 'finding' ELSE 'page' END END AS chunk_kind FROM placed p LEFT JOIN (SELECT chunk_id, category, p AS p2 FROM cats WHERE kept) k USING (chunk_id)"),
    "w02_named_definitions": sql(f"""SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, via, chunk_id) AS INTEGER) AS seq, via FROM (
        SELECT q.query_id, i.chunk_id, max(length(q.name)) AS n, 'defines:' || arg_max(q.name, (length(q.name), q.name)) AS via FROM (SELECT DISTINCT query_id, unnest(list_concat([w], list_filter(regexp_split_to_array(w, '[./:]'), lambda x: length(x) >= 3))) AS name FROM (
        SELECT query_id, {norm('w')} AS w FROM (SELECT id AS query_id, unnest(list_concat({_FOUND}, {_TICKS}, list_filter({_QUOTED}, lambda x: length(x) <= 80))) AS w FROM chunks WHERE id % 20 = 0))) q JOIN few ON few.ident = q.name JOIN ids i ON i.ident = q.name AND i.role = 'defines' GROUP BY 1, 2)"""),
    "w03_query_names": sql("SELECT query_id, name FROM chunk_names"),
    "f18_sections": sql("SELECT k.query_id AS key, CAST(coalesce(h.i, 1) AS INTEGER) AS start_line, CAST(coalesce((SELECT min(x.i) FROM any_heads x WHERE x.file_id = k.file_id AND x.i > h.i AND x.level <= h.level) - 1, k.size) AS INTEGER) AS end_line FROM frag k LEFT JOIN (SELECT query_id, arg_min(level, i) AS level, min(i) AS i FROM frag_hit GROUP BY 1) h USING (query_id)"),
    "c09_link_targets": "SELECT file_id, unnest([CASE WHEN f = '' THEN '../up/b.md' WHEN u = '' THEN 'up/b.md' ELSE u || '/up/b.md' END, CASE WHEN f = '' THEN 'c.md' ELSE f || '/c.md' END, 'https://h.example/x' || file_id, CASE WHEN f = '' THEN 'img.png' ELSE f || '/img.png' END, path]) AS target_path, unnest(['S' || n, '', '', '', 'here']) AS target_anchor FROM (SELECT t.file_id, length(coalesce(text, '')) AS n, path, regexp_replace(path, '/?[^/]*$', '') AS f, regexp_replace(regexp_replace(path, '/?[^/]*$', ''), '/?[^/]*$', '') AS u FROM file_texts t JOIN files ON files.id = t.file_id)",
    "w08_by_neighbours": sql("SELECT * FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, met) AS INTEGER) AS seq, 'neighbour' AS via FROM (SELECT k.query_id, n.chunk_id, count(*) AS votes, min((k.seq, n.rank)) AS met FROM kn_top k JOIN near3 n ON n.query_id = k.chunk_id WHERE k.seq <= 3 AND NOT EXISTS (SELECT 1 FROM kn_top x WHERE x.query_id = k.query_id AND x.seq <= 3 AND x.chunk_id = n.chunk_id) GROUP BY 1, 2)) WHERE seq <= 10"),
    "w11_search": sql("SELECT query_id, CAST(place AS INTEGER) AS seq, chunk_id, source, path, start_line, end_line, via, CAST(bm25_rank AS INTEGER) AS bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, k) AS place FROM (SELECT query_id, chunk_id, via, NULL AS bm25_rank, 0 AS part, seq AS k FROM q_named WHERE seq <= 15 UNION ALL SELECT query_id, chunk_id, '', seq, 1, seq FROM pool)) JOIN placed USING (chunk_id) WHERE place <= 5"),
    "w04_by_type": sql("SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, bm25_rank) AS INTEGER) AS seq, 'type:' || type AS via, CAST(bm25_rank AS INTEGER) AS bm25_rank FROM typed t WHERE bm25_rank <= 5 AND NOT EXISTS (SELECT 1 FROM seedpool s WHERE s.query_id = t.query_id AND s.chunk_id = t.chunk_id)"),
    "w05_by_category": sql("SELECT * FROM (SELECT i.query_id, i.chunk_id, CAST(row_number() OVER (PARTITION BY i.query_id ORDER BY r) AS INTEGER) AS seq, 'category:' || q.category AS via FROM in_about i JOIN q_cats q USING (query_id) WHERE r <= 15 AND NOT EXISTS (SELECT 1 FROM seedpool s WHERE s.query_id = i.query_id AND s.chunk_id = i.chunk_id)) WHERE seq <= 10"),
    "w06_expand": sql("SELECT query_id, chunk_id, seq, via FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, rel, chunk_id) AS INTEGER) AS seq, rel || ':' || names AS via FROM (SELECT p.query_id, b.other AS chunk_id, count(DISTINCT b.me) AS n, min(b.rel) AS rel, string_agg(DISTINCT b.via, ',' ORDER BY b.via) AS names FROM pool p JOIN both_ways b ON b.me = p.chunk_id WHERE p.seq <= 5 GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = x.query_id AND p.chunk_id = x.chunk_id)) WHERE seq <= 10"),
    "w07_distinctive_words": sql("SELECT query_id, term, round(weight, 6) AS weight FROM best_words"),
    "w07_neighbours": sql("SELECT query_id AS seed, chunk_id, CAST(rank AS INTEGER) AS rank FROM near"),
    "m02_lexical_scores": sql(f"SELECT p.query_id, p.chunk_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '{WORD}')), regexp_extract_all(lower(c.text), '{WORD}'))) / len(list_distinct(regexp_extract_all(lower(a.text), '{WORD}'))), 6) AS score FROM pool p JOIN asked a USING (query_id) JOIN chunks c ON c.id = p.chunk_id"),
    "m11_categories": sql("SELECT * FROM cats"),
    "m13_query_categories": sql("SELECT * FROM q_cats"),
    "a08_category_counts": sql("SELECT category, count(*) AS chunks FROM cats WHERE kept GROUP BY 1"),
    "e02_gold_ranks": sql("SELECT query_id, CAST(rank AS INTEGER) AS rank FROM kranks"),
    "e03_summary": sql(f"SELECT count(*) AS n, count(rank) AS in_pool, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 10) AS top10, round(avg({_NDCG}), 4) AS ndcg10, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 4) AS mrr10 FROM kranks"),
    "e03_question_rows": sql("SELECT k.query_id, CAST(k.rank AS INTEGER) AS rank, '' AS via, coalesce(k.rank <= 5, false) AS in_bm25, (SELECT string_agg(source || ':' || path || ':' || start_line || '-' || end_line, ';' ORDER BY seq) FROM krun r WHERE r.query_id = k.query_id AND seq <= 10) AS top10 FROM kranks k"),
    "e05_graded": sql("SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN (2.0 ** gain - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN (2.0 ** gain - 1) / log2(best + 1) ELSE 0 END), 6) AS ndcg10, round(count(rank) / count(*), 6) AS recall, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall10 FROM (SELECT q.query_id, q.gain, r.rank, row_number() OVER (PARTITION BY q.query_id ORDER BY gain DESC, q.doc) AS best FROM qrels2 q LEFT JOIN run_docs r USING (query_id, doc)) GROUP BY 1"),
    "e06_binary": sql("SELECT g.query_id, round(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END, 6) AS ndcg10, CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END AS recall, CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END AS recall10 FROM gold g LEFT JOIN run_docs r ON r.query_id = g.query_id AND r.doc = g.source || ':' || g.path"),
    "e10_paired_counts": sql(f"SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, round(avg(d), 4) AS mean_diff FROM (SELECT round({_NDCG.replace('rank', 'b.rank')}, 6) - round({_NDCG.replace('rank', 'a.rank')}, 6) AS d FROM kranks a JOIN kranks3 b USING (query_id))"),
    "a10_how_found": sql("SELECT 'bm25' AS how, count(*) AS n FROM kranks WHERE rank <= 10"),
    "e11_auc": sql("SELECT stratum, round(sum(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM (SELECT x.stratum, x.p AS a, y.p AS b FROM judged x JOIN judged y ON x.stratum = y.stratum AND x.ok AND NOT y.ok) GROUP BY 1"),
    "e12_negative_pools": sql("SELECT query_id, chunk_id, CAST(seq AS INTEGER) AS seq FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS seq FROM krun r WHERE r.chunk_id <> r.query_id) WHERE seq <= 10"),
    "e13_slot_swap": sql("SELECT query_id, CAST(seq AS INTEGER) AS seq, chunk_id FROM swapped"),
    "e14_hash_pick": "SELECT doc_id, CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR) || chr(9) || 'wording'), 1, 8))::BIGINT % 7 AS BIGINT) AS pick FROM documents",
    "e15_spread": sql("SELECT stratum, count(p) AS n, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.9), 6) AS p90, round(avg(p), 6) AS mean FROM judged GROUP BY 1"),
    "e16_classification": sql("SELECT stratum, n, accuracy, macro_f1 FROM (SELECT stratum, count(*) AS n, round(avg(CASE WHEN said = gold THEN 1.0 ELSE 0 END), 6) AS accuracy FROM judged GROUP BY 1) JOIN (SELECT stratum, round(avg(2 * tp / (real + told)), 6) AS macro_f1 FROM (SELECT j.stratum, c.class, count(*) FILTER (gold = class AND said = class) AS tp, count(*) FILTER (gold = class) AS real, count(*) FILTER (said = class) AS told FROM judged j, (SELECT DISTINCT gold AS class FROM judged UNION SELECT said FROM judged) c GROUP BY 1, 2) WHERE real + told > 0 GROUP BY 1) USING (stratum)"),
    "e17_calibration": sql("SELECT * FROM curve"),
    "e17_taus": sql("SELECT class, min(threshold) FILTER (kept > 0 AND precision >= 0.8 AND kept >= 0.2 * n AND ood_kept > 0 AND ood_precision >= 0.8 AND ood_kept >= 0.2 * ood_n) AS tau FROM curve GROUP BY 1"),
    "e18_threshold_curve": sql("SELECT * FROM answers_curve"),
    "e18_threshold_points": sql("SELECT arg_min(threshold, (-balanced, threshold)) AS balanced_point, coalesce(max(threshold) FILTER (keeps_answerable >= 0.9), min(threshold)) AS quiet_point FROM answers_curve"),
    "e19_gate": sql("SELECT count(*) AS n, round(avg(a), 3) AS top1_a, round(avg(b), 3) AS top1_b, round(round(avg(a - b), 4), 3) AS diff, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM (SELECT CASE WHEN a.rank = 1 THEN 1.0::DOUBLE ELSE 0 END AS a, CASE WHEN b.rank = 1 THEN 1.0::DOUBLE ELSE 0 END AS b FROM kranks a JOIN kranks3 b USING (query_id))"),
    "e22_touched_chunks": sql("SELECT DISTINCT f.id, p.chunk_id FROM (SELECT id, path, unnest(CASE WHEN id % 2 = 0 THEN [greatest(id % 9, 1), id % 9 + 1] ELSE [id % 9 + 2, id % 9 + 3] END) AS line FROM files) f JOIN placed p ON p.path = f.path AND f.line BETWEEN p.start_line AND p.end_line"),
    "e22_patch_files": "SELECT id, path FROM files WHERE path NOT LIKE '% %' AND path <> ''",
    "e23_even_sample": "WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM documents WHERE source IS NOT NULL), p AS (SELECT source, floor(k * greatest(1.0::DOUBLE, max(size)::DOUBLE / 5))::BIGINT AS i FROM n, range(5) r(k) GROUP BY source, k HAVING k < max(size)) SELECT doc_id, source FROM n JOIN p USING (source, i)",
    "e24_stratified": "SELECT doc_type, key, ('0x' || substr(key, 1, 8))::BIGINT % 5 = 0 AS held_out FROM (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY key) AS k FROM (SELECT DISTINCT doc_type, sha1(text) AS key FROM documents WHERE text <> '')) WHERE k <= 50",
    "e25_agreement": sql("SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (q >= 0.5) THEN 1.0 ELSE 0 END), 6) AS agree, round(avg(abs(p - q)), 6) AS mean_abs_diff, avg(CASE WHEN (p >= 0.5) = (q >= 0.5) THEN 1.0 ELSE 0 END) >= 0.9 AND avg(abs(p - q)) <= 0.15 AS passed FROM (SELECT p, CASE WHEN ok THEN p ELSE 1 - p END AS q FROM judged)"),
    "s05_file_changes": sql("SELECT * FROM file_status"),
    "s05_change_counts": sql("SELECT source_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status IN ('unchanged', 'restamped')) AS unchanged FROM file_status GROUP BY 1"),
    "s17_item_changes": sql("SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.item_id, o.item_id) AS item_id, CASE WHEN n.item_id IS NULL THEN 'deleted' WHEN o.item_id IS NULL OR n.version IS DISTINCT FROM o.version THEN 'fetched' WHEN n.path IS DISTINCT FROM o.path THEN 'moved' ELSE 'same' END AS status FROM listing n FULL JOIN mirror_items o ON n.source_id = o.source_id AND n.item_id = o.item_id"),
    "s17_mirrored": sql("SELECT n.source_id, n.item_id, n.version, n.path, o.meta IS NOT NULL AND n.version IS NOT DISTINCT FROM o.version AS has_meta FROM listing n LEFT JOIN mirror_items o USING (source_id, item_id)"),
    "s18_meta": sql("SELECT * FROM meta"),
    "s32_datasets": r"""SELECT dataset, arg_max(parts, (len(k), key)) AS partition_keys, arg_max(key, (modified, key)) AS newest, count(*) AS files FROM (
        SELECT CASE WHEN d <> '' THEN d ELSE key END AS dataset, array_to_string(k, ',') AS parts, k, key, modified FROM (SELECT key, modified, list_transform(list_filter(string_split(regexp_replace(key, '/?[^/]*$', ''), '/'), lambda x: contains(x, '=')), lambda x: split_part(x, '=', 1)) AS k, rtrim(regexp_extract(key, '^((?:[^/=]+/)*)', 1), '/') AS d
        FROM (SELECT 'lake/src=' || source_id || '/' || path AS key, seen_at AS modified FROM file_scans WHERE seen_at IS NOT NULL UNION ALL SELECT 'raw/' || path, seen_at FROM file_scans WHERE seen_at IS NOT NULL) WHERE regexp_matches(lower(key), '\.(csv|jsonl|ndjson|parquet|tsv)$'))) GROUP BY 1""",
    "c01_sections": sql("SELECT file_id, heading_path, anchor, CAST(min(s) AS INTEGER) AS start_line, CAST(max(e) AS INTEGER) AS end_line FROM section_rows GROUP BY 1, 2, 3"),
    "c02_lines_kept": f"SELECT t.file_id, CAST(len(list_filter(string_split(t.text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))) AS INTEGER) AS lines, CAST(len(list_filter(string_split(t.text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))) AS BIGINT) AS kept FROM file_texts t JOIN files f ON f.id = t.file_id WHERE f.lang NOT IN ('markdown', 'data', 'pdf')",
}
