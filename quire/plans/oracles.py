r"""DuckDB SQL for the queries, written apart from their Spark plans."""

U64 = "unhex(format('{{:016x}}', {0}))"


def u64(n: str) -> str:
    return f"unhex(format('{{:016x}}', CAST({n} AS BIGINT)))"


def framed(s: str) -> str:
    return f"{u64(f'strlen({s})')} || encode({s})"


ZERO, ONE = "unhex('00')", "unhex('01')"
HASH = "encode('quire-normalized-document/v1')"


def frame(section: str, parent: str, title: str, level: int, content: str, kids: str) -> str:
    up = ZERO if parent == "NULL" else f"{ONE} || {framed(parent)}"
    return f"encode('section') || {ZERO} || {framed(section)} || {up} || {framed(title)} || unhex('{level:02x}') || {framed(content)} || {u64(kids)}"


_D = """d AS (SELECT doc_id, text, 'memory:documents/' || doc_id AS source, 'sha256:' || sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL)"""
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

# Sections of conversations: the conversation itself, then its turns.
_C = rf"""
t AS (SELECT conv_id, turn, role, {_TRIM.format('text')} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations),
s AS (SELECT conv_id, 'memory:conversations/' || conv_id AS source, 'section://conversation-' || conv_id AS section_id, NULL AS parent_id, 0 AS dfs_order, 1 AS level,
             'Conversation ' || conv_id AS title, '' AS content, max(turns) AS kids FROM t GROUP BY conv_id
      UNION ALL
      SELECT conv_id, 'memory:conversations/' || conv_id, 'section://conversation-' || conv_id || '/turn-' || turn || '-' || role, 'section://conversation-' || conv_id, n, 2,
             'turn ' || turn || ' ' || role, body, 0 FROM t)"""

# Conversations as paragraphs: turns in four ways, joined by blank lines; lines of white space would split them.
_J = r"""
j AS (SELECT 'chat:' || conv_id AS document_id, string_agg(CASE turn % 4 WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 2 THEN 'a | b' || chr(10) || '--- | ---' || chr(10) || text
        WHEN 3 THEN '    ' || replace(text, chr(10), chr(10) || '    ') ELSE text END, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id),
l AS (SELECT document_id, i, line, 1 + length(line) AS w FROM (SELECT document_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM j)),
m AS (SELECT *, sum(w) OVER (PARTITION BY document_id ORDER BY i) - w AS s, trim(line) = '' AS blank FROM l),
g AS (SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY document_id ORDER BY i) AS grp FROM m),
p AS (SELECT document_id, CAST(min(s) AS BIGINT) AS range_start, CAST(max(s + length(line)) AS BIGINT) AS range_end FROM g WHERE NOT blank GROUP BY document_id, grp),
q0 AS (SELECT p.*, row_number() OVER (PARTITION BY document_id ORDER BY range_start) AS paragraph_index, substr(j.content, range_start + 1, range_end - range_start) AS text, j.content FROM p JOIN j USING (document_id)),
q1 AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM q0),
q AS (SELECT document_id, range_start, range_end, paragraph_index, text, content, CASE
        WHEN (starts_with(trim(ls[1]), '```') AND starts_with(trim(ls[-1]), '```')) OR (starts_with(trim(ls[1]), '~~~') AND starts_with(trim(ls[-1]), '~~~')) THEN 'code_block'
        WHEN len(list_filter(ls, lambda x: NOT (starts_with(x, chr(9)) OR starts_with(x, '    ')))) = 0 THEN 'code_block'
        WHEN len(ls) > 1 AND contains(ls[1], '|') AND contains(ls[2], '|') AND len(string_split(trim(trim(ls[2]), '|'), '|')) > 1
             AND len(list_filter(string_split(trim(trim(ls[2]), '|'), '|'), lambda c: NOT regexp_matches(trim(c), '^:?-{3,}:?$'))) = 0 THEN 'table'
        ELSE 'prose_or_unknown' END AS content_class FROM q1)"""

_ABBR = r"[eE]\.[gG]|[iI]\.[eE]|[eE][tT][cC]|[vV][sS]|[mM][rR]|[mM][rR][sS]|[mM][sS]|[dD][rR]|[pP][rR][oO][fF]|[sS][rR]|[jJ][rR]|[fF][iI][gG]|[eE][qQ]|[nN][oO]|[iI][nN][cC]|[lL][tT][dD]|[uU]\.[sS]|[uU]\.[kK]"
_CLOSE = """["''”’)\\]}》」』】]"""
# Sentences without lookaround: mark all ends, then take back those after abbreviations and initials.
_MARKED = rf"regexp_replace(text, '([.!?。！？]+{_CLOSE}*)(\s|$)', '\1' || chr(1) || '\2', 'g')"
_FREED = rf"regexp_replace({_MARKED}, '(^|[^\p{{L}}\p{{N}}._-])({_ABBR})\.' || chr(1) || '(\s)', '\1\2.\3', 'g')"
_INITIAL = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}._-])([A-Za-z])\.' || chr(1) || '(\s*\p{{Lu}})', '\1\2.\3', 'g')"


def sentences_of(source: str, keys: str, name: str) -> str:
    """CTEs whose last, `name`, has the sentences of source (keys, text, base): range_start, range_end, text."""
    marked = _INITIAL.format(_INITIAL.format(_FREED))
    n = name
    return rf"""{n}_m AS (SELECT {keys}, base, {marked} AS marked FROM {source}),
    {n}_c AS (SELECT {keys}, base, unnest(string_split(marked, chr(1))) AS piece, generate_subscripts(string_split(marked, chr(1)), 1) AS k FROM {n}_m),
    {n}_s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY k) - length(piece) AS spot FROM {n}_c),
    {n}_t AS (SELECT {keys}, k, {_TRIM.format('piece')} AS text, base + spot + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS s0 FROM {n}_s WHERE {_TRIM.format('piece')} <> ''),
    {n} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY k) AS sentence_index, CAST(s0 AS BIGINT) AS range_start, CAST(s0 + length(text) AS BIGINT) AS range_end, text FROM {n}_t)"""


_S = f"""d AS (SELECT doc_id, text, 0 AS base FROM documents WHERE text IS NOT NULL),
{sentences_of('d', 'doc_id', 'sentences')}"""

# The joined conversations with their sentences, and their stream: sentences, and paragraphs that have none.
_JS = f"""{_J},
prose AS (SELECT document_id, paragraph_index, range_start AS base, text FROM q WHERE content_class = 'prose_or_unknown'),
{sentences_of('prose', 'document_id, paragraph_index', 'js')},
items AS (SELECT document_id, paragraph_index, sentence_index, range_start, range_end, text, 'sentence' AS effective_kind, 'prose_or_unknown' AS content_class, CAST(NULL AS VARCHAR) AS degradation FROM js
          UNION ALL SELECT document_id, paragraph_index, NULL, range_start, range_end, text, 'paragraph', content_class, 'requested_sentence_but_non_prose_is_paragraph_only' FROM q WHERE content_class <> 'prose_or_unknown'),
st AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY paragraph_index, sentence_index NULLS FIRST) - 1 AS index FROM items)"""

# Headings of levels 1 to 4: parents by the nearest heading before of a smaller level, ids by the path of slugs.
_T = rf"""
t AS (SELECT conv_id, 'memory:deep/' || conv_id AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, (turn * 7 + conv_id) % 4 + 1 AS level, turn % 3 AS topic, {_TRIM.format('text')} AS body FROM conversations),
up AS (SELECT c.conv_id, c.n, max(a.n) AS parent FROM t c JOIN t a ON a.conv_id = c.conv_id AND a.n < c.n AND a.level < c.level GROUP BY ALL),
e AS (SELECT t.*, up.parent FROM t LEFT JOIN up USING (conv_id, n)),
paths AS (SELECT conv_id, n, 'topic-' || topic AS path, 1 AS depth, [n] AS line FROM e WHERE parent IS NULL
          UNION ALL SELECT e.conv_id, e.n, p.path || '/topic-' || e.topic, p.depth + 1, list_append(p.line, e.n) FROM e JOIN paths p ON p.conv_id = e.conv_id AND p.n = e.parent),
ids AS (SELECT conv_id, n, depth, line, 'section://' || path || CASE WHEN row_number() OVER (PARTITION BY conv_id, path ORDER BY n) > 1 THEN '-' || row_number() OVER (PARTITION BY conv_id, path ORDER BY n) ELSE '' END AS section_id FROM paths),
sec AS (SELECT e.source, e.conv_id, e.n, e.level, 'Topic ' || e.topic AS title, e.body, e.parent, ids.depth, ids.line, ids.section_id, above.section_id AS parent_id
        FROM e JOIN ids USING (conv_id, n) LEFT JOIN ids above ON above.conv_id = e.conv_id AND above.n = e.parent)"""
_SIZES = """sizes AS (SELECT a.conv_id, a.n, count(*) AS subtree_size, count(*) FILTER (WHERE b.parent = a.n) AS child_count FROM sec a JOIN sec b ON b.conv_id = a.conv_id AND list_contains(b.line, a.n) GROUP BY ALL)"""

# URLs of pages, by page turned into others.
_URLS = r"""
u AS (SELECT page_id, CASE page_id % 16 WHEN 1 THEN 'http://127.0.0.1' || rest WHEN 2 THEN 'https://10.1.2.3:8080' || rest WHEN 3 THEN 'http://user:pw@example.com' || rest WHEN 4 THEN 'ftp://example.com' || rest
        WHEN 5 THEN 'https://LOCALHOST' || rest WHEN 6 THEN 'http://printer.local' || rest WHEN 7 THEN 'https://8.8.8.8' || rest WHEN 8 THEN 'http://172.20.0.1' || rest WHEN 9 THEN 'http://2130706433' || rest
        WHEN 10 THEN 'https://example.com.' || rest WHEN 11 THEN 'http://[::1]' || rest WHEN 12 THEN 'https://host:99/a.PDF?x=.md' ELSE url END AS url
      FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://[^/]*', '') AS rest FROM pages)),
v AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority FROM u),
w AS (SELECT *, rtrim(lower(CASE WHEN starts_with(authority, '[') THEN authority ELSE string_split(authority, ':')[1] END), '.') AS name FROM v),
hosts AS (SELECT *, CASE WHEN scheme IN ('http', 'https') AND NOT contains(authority, '@') THEN name END AS host, TRY_CAST(string_split(name, '.')[1] AS INTEGER) AS o1, TRY_CAST(string_split(name, '.')[2] AS INTEGER) AS o2,
          regexp_matches(name, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') AS quad FROM w)"""

_EDGE = r"[^\p{L}\p{N}\-./:+#$@]+"


def tokens(t: str) -> str:
    segs = rf"list_transform(list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g'))"
    return rf"list_distinct(flatten(list_transform({segs}, lambda x: list_concat(CASE WHEN regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN [x] ELSE [] END, regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+')))))"


# All units of documents with their tokens: title, paragraph (the text, as no line is blank), sentences.
_U = rf"""{_S},
raw AS (SELECT doc_id, 'section' AS kind, 0 AS k, 0 AS si, 'memory:documents/' || doc_id AS text, 0 AS s0 FROM d
        UNION ALL SELECT doc_id, 'paragraph', 1, 0, regexp_replace(text, '\s*$', ''), 0 FROM d WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''
        UNION ALL SELECT doc_id, 'sentence', 2, sentence_index, text, range_start FROM sentences),
tok AS (SELECT *, {tokens('text')} AS tokens FROM raw),
units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, si) - 1 AS source_order FROM tok WHERE len(tokens) > 0),
post AS (SELECT doc_id, source_order, unnest(tokens) AS token FROM units),
queries AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS query FROM benchmark),
qt AS (SELECT query_id, query, unnest({tokens('query')}) AS token FROM queries),
qn AS (SELECT query_id, query, count(*) AS n FROM qt GROUP BY ALL),
hit AS (SELECT query_id, doc_id, source_order, count(*) AS n FROM qt JOIN post USING (token) GROUP BY ALL),
hits AS (SELECT h.query_id, qn.query, qn.n, u.* FROM hit h JOIN qn ON qn.query_id = h.query_id AND qn.n = h.n JOIN units u ON u.doc_id = h.doc_id AND u.source_order = h.source_order),
ids AS (SELECT doc_id, 'doc:sha256:' || sha256(encode('memory:documents/' || doc_id) || {ZERO} || encode('sha256:' || sha256(text))) AS document_id FROM d)"""

# The hash of a joined conversation, and a block for each of its paragraphs, the second of each spoilt.
_H = "h AS (SELECT document_id, content, 'sha256:' || sha256(content) AS content_hash, 'nd1:' || sha256(" + HASH + " || " + ZERO + " || " + u64("1") + " || " + frame("'section://document'", "NULL", "'chat'", 1, "content", "0") + " || encode('blocks:absent')) AS nh FROM j)"
_B = """z AS (SELECT document_id, length(content) AS chars, paragraph_index AS i, range_start AS lo, range_end AS hi, CASE WHEN paragraph_index = 2 THEN CAST(substr(document_id, 6) AS BIGINT) % 9 ELSE 0 END AS k FROM q),
b AS (SELECT document_id, chars, CASE k WHEN 2 THEN 'section://none' ELSE 'section://document' END AS section_id, i + (CASE k WHEN 3 THEN 1 ELSE 0 END) AS block_index, i - 1 + (CASE k WHEN 1 THEN 1000 ELSE 0 END) AS source_order,
      CASE k WHEN 4 THEN 'picture' ELSE 'paragraph' END AS kind, CASE k WHEN 5 THEN hi + 1 WHEN 7 THEN hi WHEN 8 THEN lo - 3 ELSE lo END AS range_start, CASE k WHEN 6 THEN hi + 100000 ELSE hi END AS range_end FROM z)"""

ORACLES = {
    "ingest_document_identity": f"WITH {_D} SELECT doc_id, 'doc:sha256:' || sha256(encode(source) || {ZERO} || encode(content_hash)) AS document_id, content_hash, source AS title, length(text) AS chars FROM d",
    "normalized_hash_flat": f"WITH {_D} SELECT doc_id, 'nd1:' || sha256({HASH} || {ZERO} || {u64('1')} || {frame(chr(39) + 'section://document' + chr(39), 'NULL', 'source', 1, 'text', '0')} || encode('blocks:absent')) AS normalized_hash FROM d",
    "normalized_hash_tree": f"""WITH {_C}, f AS (SELECT source, dfs_order, CASE WHEN dfs_order = 0 THEN {frame('section_id', 'NULL', 'title', 1, 'content', 'kids')} ELSE {frame('section_id', 'parent_id', 'title', 2, 'content', 'kids')} END AS f FROM s)
        SELECT source, 'nd1:' || sha256({HASH} || {ZERO} || {u64('1')} || unhex(string_agg(hex(f), '' ORDER BY dfs_order)) || encode('blocks:absent')) AS normalized_hash FROM f GROUP BY source""",
    "section_catalog": f"WITH {_C} SELECT source, section_id, parent_id, CAST(dfs_order AS BIGINT) AS dfs_order, CAST(level AS BIGINT) AS level, title, length(content) AS chars, CAST(level AS BIGINT) AS depth, CAST(kids AS BIGINT) AS child_count, CAST(kids + 1 AS BIGINT) AS subtree_size FROM s",
    "section_count_budget": f"WITH {_C} SELECT source, count(*) AS section_count, CAST(max(level) AS BIGINT) AS max_depth, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) > 6 OR sum(length(content)) > 4000 AS over FROM s GROUP BY source",
    "outline_depth_limited": f"WITH {_C} SELECT source, section_id, title, false AS truncated FROM s WHERE level = 1",
    "outline_first_n": f"WITH {_C}, r AS (SELECT source, section_id, dfs_order + 1 AS rank, count(*) OVER (PARTITION BY source) > 3 AS truncated FROM s) SELECT source, section_id, CAST(rank AS BIGINT) AS rank, truncated FROM r WHERE rank <= 3",
    "ancestors": f"WITH {_C} SELECT source, section_id, 0::BIGINT AS position, parent_id AS ancestor_id FROM s WHERE parent_id IS NOT NULL",
    "children": f"WITH {_C} SELECT source, parent_id AS section_id, section_id AS child_id FROM s WHERE parent_id IS NOT NULL",
    "siblings": f"WITH {_C} SELECT a.source, a.section_id, b.section_id AS sibling_id FROM s a JOIN s b ON a.source = b.source AND a.parent_id = b.parent_id AND a.section_id <> b.section_id",
    "section_neighbours": f"WITH {_C} SELECT a.source, a.section_id AS anchor_id, CAST(b.dfs_order - a.dfs_order AS BIGINT) AS \"offset\", CASE sign(b.dfs_order - a.dfs_order) WHEN -1 THEN 'before' WHEN 1 THEN 'after' ELSE 'anchor' END AS role, b.section_id FROM s a JOIN s b ON a.source = b.source AND abs(a.dfs_order - b.dfs_order) <= 1",
    "render_section_tree": f"WITH {_C} SELECT source, {_TRIM.format(chr(40) + 'string_agg(repeat(chr(35), level) || chr(32) || title || chr(10) || chr(10) || CASE WHEN content = chr(0) OR content = repeat(chr(32), 0) THEN repeat(chr(32), 0) ELSE content || chr(10) || chr(10) END, repeat(chr(32), 0) ORDER BY dfs_order)' + chr(41))} AS content FROM s GROUP BY source",
    "read_page": "SELECT doc_id, substr(text, 501, 300) AS content, least(800, length(text)) AS end_at, length(text) AS total, least(800, length(text)) >= length(text) AS complete FROM documents WHERE text IS NOT NULL",
    "paragraph_units": f"WITH {_J} SELECT document_id, paragraph_index, paragraph_index - 1 AS source_order, range_start, range_end, text, content_class FROM q",
    "paragraph_coverage": f"WITH {_J} SELECT document_id, length(content) AS owner_chars, count(*) AS paragraph_count, CAST(sum(range_end - range_start) AS BIGINT) AS paragraph_chars, CAST(length(content) - sum(range_end - range_start) AS BIGINT) AS separator_chars, CAST(sum(range_end - range_start) AS BIGINT) AS fallback_chars FROM q GROUP BY document_id, content",
    "paragraph_ids": f"""WITH {_J}, h AS (SELECT *, 'nd1:' || sha256({HASH} || {ZERO} || {u64('1')} || {frame(chr(39) + 'section://document' + chr(39), 'NULL', chr(39) + 'chat' + chr(39), 1, 'content', '0')} || encode('blocks:absent')) AS nh FROM q)
        SELECT document_id, paragraph_index, 'tu1:' || sha256(encode('quire-text-unit/v1') || {framed('document_id')} || {framed('nh')} || {framed(chr(39) + 'section://document' + chr(39))} || {framed(chr(39) + 'paragraph' + chr(39))} || {u64('paragraph_index')} || {u64('range_start')} || {u64('range_end')} || {framed(chr(39) + 'quire-segments/3' + chr(39))}) AS unit_id FROM h""",
    "exact_slice_roundtrip": f"WITH {_J} SELECT document_id, count(*) AS paragraphs, count(*) FILTER (WHERE substr(content, range_start + 1, range_end - range_start) = text) AS exact FROM q GROUP BY document_id",
    "paragraph_content_class": rf"""WITH {_D}, {_J} SELECT 'doc:sha256:' || sha256(encode(source) || {ZERO} || encode(content_hash)) AS document_id, 'prose_or_unknown' AS content_class, 1::BIGINT AS paragraphs, CAST(length(regexp_replace(text, '\s*$', '')) AS BIGINT) AS chars FROM d WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''
        UNION ALL SELECT document_id, content_class, count(*), CAST(sum(range_end - range_start) AS BIGINT) FROM q GROUP BY document_id, content_class""",
    "sentence_units": f"WITH {_S} SELECT * FROM sentences",
    "sentence_coverage": f"""WITH {_S} SELECT d.doc_id, length(regexp_replace(d.text, '\\s*$', '')) AS paragraph_chars, count(s.text) AS sentence_count, CAST(sum(length(s.text)) AS BIGINT) AS sentence_chars,
        CAST(length(regexp_replace(d.text, '\\s*$', '')) - sum(length(s.text)) AS BIGINT) AS separator_chars, 0::BIGINT AS coarse_only_chars FROM d JOIN sentences s USING (doc_id) GROUP BY d.doc_id, d.text""",
    "token_postings": f"SELECT doc_id, unnest({tokens('text')}) AS token FROM documents WHERE text IS NOT NULL",
    "document_frequency": f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token",
    "lexical_candidates": f"WITH {_U} SELECT doc_id, source_order, kind, substr(text, 1, 320) AS snippet, CAST(len(tokens) AS BIGINT) AS n_tokens FROM units",
    "search_all_tokens": f"WITH {_U} SELECT query_id, kind, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM hits GROUP BY query_id, kind",
    "search_rank_phrase": f"""WITH {_U}, r AS (SELECT h.*, CAST(CASE WHEN contains(lower(text), lower(query)) THEN 4 ELSE 0 END + n + CASE kind WHEN 'sentence' THEN 1 WHEN 'paragraph' THEN 0.5 ELSE 0.25 END AS DOUBLE) AS score, ids.document_id FROM hits h JOIN ids USING (doc_id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE kind WHEN 'sentence' THEN 0 WHEN 'paragraph' THEN 1 ELSE 2 END, document_id, s0, source_order) AS rank FROM r)
        SELECT query_id, rank, kind, doc_id, source_order, round(score, 6) AS score FROM o WHERE rank <= 10""",
    "search_rank_bm25": f"""WITH {_U}, total AS (SELECT count(*) AS nu, avg(len(tokens)) AS al FROM units), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
        w AS (SELECT query_id, sum(CASE WHEN ln((nu - df + 0.5) / (df + 0.5)) > 0 THEN ln((nu - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) AS idf FROM qt JOIN df USING (token), total GROUP BY query_id),
        r AS (SELECT h.*, ids.document_id, 1 / (1 + w.idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(h.tokens) / al))) AS score FROM hits h JOIN w USING (query_id) JOIN ids ON ids.doc_id = h.doc_id, total),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(tokens), document_id, source_order) AS rank FROM r)
        SELECT query_id, rank, kind, doc_id, source_order, round(score, 6) AS score FROM o WHERE rank <= 10""",
    "text_unit_page": f"WITH {_S}, r AS (SELECT doc_id, sentence_index - 1 AS position, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY sentence_index) AS c FROM sentences WHERE sentence_index > 10) SELECT doc_id, position, text FROM r WHERE c <= 600 AND position < 20",
    "text_unit_page_backward": f"WITH {_S}, r AS (SELECT doc_id, sentence_index - 1 AS position, text, sum(length(text)) OVER w AS c, row_number() OVER w AS n FROM sentences WHERE sentence_index <= 15 WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_index DESC)) SELECT doc_id, position, text FROM r WHERE c <= 400 AND n <= 5",
    "atomic_item_budget": f"WITH {_S} SELECT doc_id, max(length(text)) AS longest, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS total, max(length(text)) <= 2000 AND sum(length(text)) + 2 * (count(*) - 1) <= 2000 AS fits FROM sentences GROUP BY doc_id",
    "locator_resolution": f"""WITH {_JS}, {_H},
        spots AS (SELECT document_id, paragraph_index, sentence_index, range_start, range_end, paragraph_index + sentence_index AS k FROM js
               UNION ALL SELECT document_id, paragraph_index, NULL, range_start, range_end, paragraph_index * 5 + length(text) FROM q
               UNION ALL SELECT document_id, NULL, NULL, 3, length(content), length(content) FROM j
               UNION ALL SELECT document_id, NULL, NULL, NULL, NULL, length(content) * 3 FROM j),
        loc AS (SELECT CASE k % 8 WHEN 1 THEN 'no ' || document_id ELSE document_id END AS document_id, CASE k % 8 WHEN 2 THEN 'sha256:other' ELSE content_hash END AS ch, CASE k % 8 WHEN 3 THEN 'nd1:other' ELSE nh END AS nh,
                CASE k % 8 WHEN 4 THEN 'section://none' ELSE 'section://document' END AS section_id, CASE WHEN k % 8 = 5 THEN paragraph_index + 1 ELSE paragraph_index END AS p, sentence_index AS s,
                range_start AS a, CASE WHEN k % 8 = 6 THEN range_end + 1 ELSE range_end END AS b, CASE WHEN paragraph_index IS NULL THEN NULL WHEN k % 8 = 7 THEN 'other' ELSE 'quire-segments/3' END AS seg, k % 8 AS spoilt
                FROM spots JOIN h USING (document_id)),
        kinds AS (SELECT *, CASE WHEN s IS NOT NULL THEN 'sentence' WHEN p IS NOT NULL THEN 'paragraph' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'character_range' WHEN a IS NULL AND b IS NULL THEN 'section' END AS kind FROM loc),
        res AS (SELECT kinds.*, h.content_hash, h.nh AS now, length(h.content) AS chars, CASE kind WHEN 'sentence' THEN js.range_start WHEN 'paragraph' THEN q.range_start END AS ua, CASE kind WHEN 'sentence' THEN js.range_end WHEN 'paragraph' THEN q.range_end END AS ub
                FROM kinds LEFT JOIN h ON h.document_id = kinds.document_id LEFT JOIN q ON q.document_id = kinds.document_id AND q.paragraph_index = p AND section_id = 'section://document'
                LEFT JOIN js ON js.document_id = kinds.document_id AND js.paragraph_index = p AND js.sentence_index = s AND section_id = 'section://document'),
        done AS (SELECT document_id, kind, spoilt, CASE WHEN content_hash IS NULL THEN 'not_found' WHEN ch <> content_hash OR nh <> now THEN 'stale' WHEN section_id <> 'section://document' OR kind IS NULL THEN 'invalid'
                 WHEN seg <> 'quire-segments/3' THEN 'stale' WHEN kind IN ('paragraph', 'sentence') AND (ua IS NULL OR ua <> a OR ub <> b) THEN 'invalid' WHEN a > b OR b > chars THEN 'invalid' ELSE 'ok' END AS verdict FROM res)
        SELECT document_id, kind, verdict, CAST(spoilt AS BIGINT) AS spoilt, count(*) AS locators FROM done GROUP BY ALL""",
    "sentence_ids": f"""WITH {_JS}, {_H} SELECT document_id, paragraph_index, sentence_index, row_number() OVER (PARTITION BY document_id ORDER BY paragraph_index, sentence_index) - 1 AS source_order,
        'tu1:' || sha256(encode('quire-text-unit/v1') || {framed('document_id')} || {framed('nh')} || {framed(chr(39) + 'section://document' + chr(39))} || {framed(chr(39) + 'sentence' + chr(39))} || {u64('paragraph_index')} || {u64('sentence_index')} || {u64('range_start')} || {u64('range_end')} || {framed(chr(39) + 'quire-segments/3' + chr(39))}) AS unit_id
        FROM js JOIN h USING (document_id)""",
    "text_unit_stream": f"WITH {_JS} SELECT document_id, index, paragraph_index, coalesce(sentence_index, 0) AS sentence_index, effective_kind, content_class, degradation, range_start, range_end FROM st",
    "enumeration_coverage": f"""WITH {_JS}, c AS (SELECT document_id, paragraph_index, count(*) AS n, sum(range_end - range_start) AS chars FROM js GROUP BY ALL)
        SELECT q.document_id, length(content) AS owner_chars, CAST(length(content) - sum(range_end - range_start) AS BIGINT) AS section_separator_chars,
        CAST(coalesce(sum(range_end - range_start - coalesce(c.chars, 0)) FILTER (WHERE content_class = 'prose_or_unknown'), 0) AS BIGINT) AS sentence_separator_chars, count(*) AS paragraph_count,
        count(*) FILTER (WHERE content_class = 'prose_or_unknown') AS sentence_eligible_paragraphs, count(*) FILTER (WHERE content_class IN ('code_block', 'table')) AS non_prose_paragraphs, 0::BIGINT AS coarse_structural_paragraphs,
        count(*) FILTER (WHERE content_class <> 'prose_or_unknown') AS represented_paragraphs, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS represented_sentences, count(*) FILTER (WHERE content_class <> 'prose_or_unknown') AS coarse_non_prose_items,
        0::BIGINT AS coarse_structural_items, 0::BIGINT AS intentionally_skipped, 0::BIGINT AS unsupported_gaps, true AS source_complete
        FROM q LEFT JOIN c USING (document_id, paragraph_index) GROUP BY q.document_id, content""",
    "coverage_policy_skip": f"""WITH {_JS}, c AS (SELECT document_id, paragraph_index, sum(range_end - range_start) AS chars FROM js GROUP BY ALL)
        SELECT q.document_id, length(content) AS owner_chars, CAST(length(content) - sum(range_end - range_start) AS BIGINT) AS section_separator_chars,
        CAST(coalesce(sum(range_end - range_start - coalesce(c.chars, 0)) FILTER (WHERE content_class = 'prose_or_unknown'), 0) AS BIGINT) AS sentence_separator_chars, count(*) AS paragraph_count,
        count(*) FILTER (WHERE content_class = 'prose_or_unknown') AS sentence_eligible_paragraphs, count(*) FILTER (WHERE content_class IN ('code_block', 'table')) AS non_prose_paragraphs, 0::BIGINT AS coarse_structural_paragraphs,
        count(*) FILTER (WHERE content_class = 'prose_or_unknown') AS represented_paragraphs, 0::BIGINT AS represented_sentences, 0::BIGINT AS coarse_non_prose_items, 0::BIGINT AS coarse_structural_items,
        count(*) FILTER (WHERE content_class <> 'prose_or_unknown') AS intentionally_skipped, 0::BIGINT AS unsupported_gaps, false AS source_complete
        FROM q LEFT JOIN c USING (document_id, paragraph_index) GROUP BY q.document_id, content""",
    "text_units_page_anchored": f"""WITH {_JS}, x AS (SELECT a.document_id, a.index AS anchor_index, b.index, b.effective_kind, b.range_start, b.range_end, sum(length(b.text)) OVER (PARTITION BY a.document_id, a.index ORDER BY b.index) AS c
        FROM st a JOIN st b ON a.document_id = b.document_id AND b.index BETWEEN a.index + 1 AND a.index + 4 WHERE a.index % 7 = 3) SELECT document_id, anchor_index, index, effective_kind, range_start, range_end FROM x WHERE c <= 300""",
    "text_units_page_anchored_backward": f"""WITH {_JS}, x AS (SELECT a.document_id, a.index AS anchor_index, b.index, b.effective_kind, b.range_start, b.range_end, sum(length(b.text)) OVER (PARTITION BY a.document_id, a.index ORDER BY b.index DESC) AS c
        FROM st a JOIN st b ON a.document_id = b.document_id AND b.index BETWEEN a.index - 4 AND a.index - 1 WHERE a.index % 7 = 3) SELECT document_id, anchor_index, index, effective_kind, range_start, range_end FROM x WHERE c <= 300""",
    "neighbors_sentence": f"""WITH {_JS} SELECT a.document_id, a.index AS anchor_index, b.index - a.index AS "offset", CASE sign(b.index - a.index) WHEN -1 THEN 'before' WHEN 1 THEN 'after' ELSE 'anchor' END AS role, b.effective_kind,
        CASE WHEN b.effective_kind = 'paragraph' THEN 'requested_sentence_context_but_non_prose_is_paragraph_only' END AS degradation, b.range_start FROM st a JOIN st b ON a.document_id = b.document_id AND b.index BETWEEN a.index - 1 AND a.index + 2""",
    "neighbors_paragraph": f"""WITH {_J} SELECT a.document_id, a.paragraph_index - 1 AS anchor_index, b.paragraph_index - a.paragraph_index AS "offset", CASE sign(b.paragraph_index - a.paragraph_index) WHEN -1 THEN 'before' WHEN 1 THEN 'after' ELSE 'anchor' END AS role,
        b.content_class, b.range_start, b.range_end FROM q a JOIN q b ON a.document_id = b.document_id AND b.paragraph_index BETWEEN a.paragraph_index - 2 AND a.paragraph_index + 1""",
    "container_paragraph": f"WITH {_JS} SELECT js.document_id, js.paragraph_index, js.sentence_index AS anchor_sentence_index, q.range_start, q.range_end, 'container' AS role, q.content_class FROM js JOIN q ON q.document_id = js.document_id AND q.paragraph_index = js.paragraph_index",
    "container_section": f"WITH {_JS} SELECT js.document_id, 'chat' AS title, 'container' AS role, count(*) AS sentences, max(length({_TRIM.format('content')})) AS chars FROM js JOIN j USING (document_id) GROUP BY js.document_id",
    "context_budget": f"""WITH {_JS} SELECT a.document_id, a.index AS anchor_index, count(*) AS items, CAST(sum(length(b.text)) + 2 * (count(*) - 1) AS BIGINT) AS chars, sum(length(b.text)) + 2 * (count(*) - 1) <= 400 AS fits
        FROM st a JOIN st b ON a.document_id = b.document_id AND abs(b.index - a.index) <= 1 GROUP BY a.document_id, a.index""",
    "read_pages_concat": "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 300.0) AS BIGINT)) AS pages, 1::BIGINT AS complete, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL",
    "markdown_headings": f"WITH RECURSIVE {_T} SELECT source, n AS dfs_order, CAST(level AS BIGINT) AS level, title FROM sec",
    "markdown_section_bodies": f"WITH RECURSIVE {_T} SELECT source, n AS dfs_order, body AS content FROM sec",
    "deep_section_catalog": f"WITH RECURSIVE {_T}, {_SIZES} SELECT source, section_id, parent_id, n AS dfs_order, CAST(depth AS BIGINT) AS depth, child_count, subtree_size FROM sec JOIN sizes USING (conv_id, n)",
    "deep_ancestors": f"WITH RECURSIVE {_T} SELECT a.source, a.section_id, CAST(b.depth - 1 AS BIGINT) AS position, b.section_id AS ancestor_id FROM sec a JOIN sec b ON a.conv_id = b.conv_id AND list_contains(a.line, b.n) AND a.n <> b.n",
    "deep_siblings": f"WITH RECURSIVE {_T} SELECT a.source, a.section_id, b.section_id AS sibling_id FROM sec a JOIN sec b ON a.conv_id = b.conv_id AND a.parent IS NOT DISTINCT FROM b.parent AND a.n <> b.n",
    "deep_outline": f"WITH RECURSIVE {_T}, r AS (SELECT source, section_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS rank, count(*) OVER (PARTITION BY conv_id) > 5 AS truncated FROM sec WHERE depth <= 2) SELECT * FROM r WHERE rank <= 5",
    "deep_render": f"""WITH RECURSIVE {_T} SELECT a.source, a.section_id, sha256({_TRIM.format(chr(40) + "string_agg(repeat('#', b.level::INTEGER) || ' ' || b.title || chr(10) || chr(10) || CASE WHEN b.body = '' THEN '' ELSE b.body || chr(10) || chr(10) END, '' ORDER BY b.n)" + chr(41))}) AS content_sha256
        FROM sec a JOIN sec b ON a.conv_id = b.conv_id AND list_contains(b.line, a.n) GROUP BY a.source, a.section_id, a.n""",
    "sibling_order": f"WITH RECURSIVE {_T} SELECT source, section_id, row_number() OVER (PARTITION BY conv_id, parent ORDER BY n) - 1 AS place FROM sec",
    "enriched_tree": f"WITH RECURSIVE {_T}, {_SIZES} SELECT source, section_id, CAST(depth - 1 AS BIGINT) AS ancestors, CAST(depth AS BIGINT) AS depth, child_count, subtree_size FROM sec JOIN sizes USING (conv_id, n)",
    "block_map_violations": f"""WITH {_J}, {_B}, f AS (SELECT document_id, source_order, CASE WHEN source_order <> row_number() OVER (PARTITION BY document_id ORDER BY source_order) - 1 THEN 'source_order_gap' WHEN section_id <> 'section://document' THEN 'unknown_owner'
        WHEN block_index <> row_number() OVER per THEN 'block_index_gap' WHEN kind = 'picture' THEN 'unknown_kind' WHEN range_start > range_end THEN 'range_order' WHEN range_end > chars THEN 'range_out_of_bounds' WHEN range_start = range_end THEN 'empty_block'
        WHEN range_start < lag(range_end) OVER per THEN 'overlap' END AS error FROM b WINDOW per AS (PARTITION BY document_id, section_id ORDER BY source_order))
        SELECT document_id, min(source_order) AS source_order, arg_min(error, (source_order, error)) AS error FROM f WHERE error IS NOT NULL GROUP BY document_id""",
    "block_paragraph_match": f"""WITH {_J}, {_B} SELECT b.document_id, count(q.document_id) AS exact, count(*) - count(q.document_id) AS inexact FROM b LEFT JOIN q ON q.document_id = b.document_id AND b.section_id = 'section://document' AND q.range_start = b.range_start AND q.range_end = b.range_end GROUP BY b.document_id""",
    "range_overlap_semi": f"WITH {_JS} SELECT document_id, paragraph_index, sentence_index, range_start, range_end FROM js WHERE (100 < range_end AND range_start < 200) OR (350 < range_end AND range_start < 360)",
    "cjk_tokens": r"""WITH c AS (SELECT doc_id, translate(CAST(doc_id AS VARCHAR), '0123456789', '零一二三四五六七八九') AS w FROM documents),
        r AS (SELECT doc_id, w FROM c UNION ALL SELECT doc_id, '第一章' FROM c),
        k AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(w, '.'), list_transform(range(1, length(w)), lambda i: substr(w, i, 2)))) AS token FROM r)
        SELECT DISTINCT doc_id, token FROM k UNION ALL SELECT doc_id, unnest(['id:', 'id', 'read-only', 'read', 'only']) FROM c""",
    "url_policy_verdicts": f"""WITH {_URLS} SELECT page_id, url, host, CASE WHEN scheme NOT IN ('http', 'https') THEN 'not_http' WHEN contains(authority, '@') THEN 'credentials' WHEN host IS NULL THEN 'no_host'
        WHEN starts_with(host, '[') OR host = 'localhost' OR host LIKE '%.local' OR (quad AND (o1 IN (0, 10, 127) OR o1 >= 224 OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168))) OR (NOT quad AND regexp_matches(host, '^[0-9.]+$')) THEN 'closed_host' ELSE 'ok' END AS verdict FROM hosts""",
    "host_allowlist": f"WITH {_URLS} SELECT page_id, coalesce(host LIKE '%.example.com' OR host = 'example.com' OR host LIKE '%.example.org', false) AS allowed, scheme IN ('http', 'https') AS http FROM hosts",
    "media_type_routing": rf"""WITH {_URLS}, k AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'text/html' WHEN 3 THEN 'image/png' ELSE CASE lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\.([^./]+)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' END END AS media_type FROM u)
        SELECT page_id, media_type, coalesce(media_type IN ('text/html', 'application/pdf'), false) AS allowed FROM k""",
    "replace_by_document": "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || ' again' ELSE text END) AS text_sha256 FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0",
    "rebuild_missing_index": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND (doc_id % 5 = 0 OR doc_id % 7 = 0)",
    "html_titles": r"""SELECT 'memory:pages/' || page_id AS source, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')), '') AS html_title,
        'sha256:' || sha256(html) AS content_hash FROM pages""",
    "json_properties": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS events FROM events GROUP BY 1",
}
