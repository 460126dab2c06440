"""DuckDB SQL for the named queries. Written apart from the Spark plans: joins, windows and recursion in place of folds."""

from __future__ import annotations

from .functions import lexemes as L
from .functions import text as T
from .functions.ids import NAMESPACE
from .plans import catalog


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_DIST = "1 - list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _dense(queries: str, where: str = "TRUE", k: int = 20) -> str:
    return f"""SELECT query_id, guid, d AS cosine_distance, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS guid, {_DIST} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, c.vec_id)::INT AS rank
  FROM embeddings c, (SELECT * FROM embeddings WHERE {queries}) q WHERE {where}) WHERE rank <= {k}"""


_STOP = ", ".join(f"'{w}'" for w in L.STOP)
_TOKENS = lambda table, key, name: f"(SELECT {key} AS {name}, unnest(regexp_extract_all(lower(text), '{L.TOKEN}')) AS word FROM {table})"
_TERMS = f"(SELECT DISTINCT query_id, term FROM ({L.stemmed_sql(f'SELECT DISTINCT query_id, word FROM {_TOKENS("benchmark", "item_id", "query_id")} WHERE word NOT IN ({_STOP})')}))"


def _postings(of: str = "documents") -> str:
    counted = f"SELECT guid, word, count(*) AS n FROM {_TOKENS(of, 'doc_id', 'guid')} WHERE word NOT IN ({_STOP}) GROUP BY ALL"
    return f"(SELECT guid, term, sum(n)::BIGINT AS tf FROM ({L.stemmed_sql(counted)}) GROUP BY ALL)"


def _keyword(k: int, of: str = "documents") -> str:
    return f"""(SELECT * FROM (SELECT query_id, guid, 0.1::DOUBLE * n AS text_rank, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, guid)::INT AS rank
  FROM (SELECT query_id, guid, sum(tf) AS n FROM {_postings(of)} p JOIN {_TERMS} t USING (term) GROUP BY ALL)) WHERE rank <= {k})"""


def _phrases() -> str:
    """Phrases, required and excluded words by joins; covers by a self-join over ends."""
    at = lambda i: f"coalesce(w[{i + 1}], '')"
    text = f"""'"' || {at(0)} || ' ' || {at(1)} || '" ' || {at(3)} || ' -' || {at(8)} || ' or ' || {at(4)} || ' ' || {at(5)} || ' OR ' || {at(2)} || ' "' || {at(6)} || ' ' || {at(7)} || '"'"""
    words = r"""list_filter(regexp_split_to_array(replace(text, '"', ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '')"""
    return f"""WITH q AS (
  SELECT query_id, {text} AS text FROM (SELECT item_id AS query_id, {words} AS w FROM benchmark)
), items AS (
  SELECT query_id, unnest(xs) AS raw, generate_subscripts(xs, 1) - 1 AS item FROM (SELECT query_id, regexp_extract_all(text, '-?"[^"]*"|[^ \\t\\n\\x0b\\x0c\\r"]+') AS xs FROM q)
), grouped AS (
  SELECT *, sum(CASE WHEN lower(raw) = 'or' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY item) AS grp FROM items
), parts AS (
  SELECT query_id, grp, item, raw LIKE '-%' AS negated, unnest(ts) AS word, generate_subscripts(ts, 1) - 1 AS off
  FROM (SELECT *, regexp_extract_all(lower(raw), '{L.TOKEN}') AS ts FROM grouped WHERE lower(raw) <> 'or')
), asked AS (
  SELECT query_id, grp, item, negated, off, term, count(*) OVER (PARTITION BY query_id, item) AS n FROM ({L.stemmed_sql(f"SELECT * FROM parts WHERE word NOT IN ({_STOP})")})
), places AS (
  SELECT * FROM (SELECT guid, unnest(ts) AS word, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT doc_id AS guid, regexp_extract_all(lower(text), '{L.TOKEN}') AS ts FROM documents)) WHERE word NOT IN ({_STOP})
), hits AS (
  SELECT DISTINCT query_id, guid, grp, item, negated, off, n, pos FROM places JOIN ({L.stemmed_sql("SELECT DISTINCT word FROM places")}) USING (word) JOIN asked USING (term)
), found AS (
  SELECT query_id, guid, grp, item, negated, min(pos) AS s, max(pos) AS e FROM hits GROUP BY query_id, guid, grp, item, negated, n, pos - off HAVING count(*) = n
), wanted AS (
  SELECT query_id, grp, count(DISTINCT item) FILTER (WHERE NOT negated) AS items FROM asked GROUP BY ALL
), matched AS (
  SELECT query_id, guid, grp, items FROM (SELECT query_id, guid, grp, count(DISTINCT item) FILTER (WHERE NOT negated) AS met, bool_or(negated) AS spoilt FROM found GROUP BY ALL) JOIN wanted USING (query_id, grp) WHERE NOT spoilt AND met = items
), held AS (
  SELECT query_id, guid, grp, item, items, s, e FROM found JOIN matched USING (query_id, guid, grp) WHERE NOT negated
), lasts AS (
  SELECT x.query_id, x.guid, x.grp, x.items, x.e, y.item, max(y.s) AS last
  FROM (SELECT DISTINCT query_id, guid, grp, items, e FROM held) x JOIN held y ON x.query_id = y.query_id AND x.guid = y.guid AND x.grp = y.grp AND y.e <= x.e GROUP BY ALL
), whole AS (
  SELECT query_id, guid, e, max(s) AS s FROM (SELECT query_id, guid, grp, items, e, min(last) AS s FROM lasts GROUP BY ALL HAVING count(*) = items) GROUP BY ALL
), covers AS (
  SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY query_id, guid ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM whole) WHERE known IS NULL OR s > known
), weighed AS (
  SELECT c.query_id, c.guid, 0.1::DOUBLE / (1 + c.e - c.s - (count(DISTINCT h.pos) - 1)) AS cover FROM covers c JOIN hits h ON h.query_id = c.query_id AND h.guid = c.guid AND h.pos BETWEEN c.s AND c.e GROUP BY c.query_id, c.guid, c.s, c.e
)
SELECT query_id, guid, round(text_rank, 9) AS text_rank, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(text_rank, 12) DESC, guid)::INT AS rank FROM (SELECT query_id, guid, sum(cover ORDER BY cover) AS text_rank FROM weighed GROUP BY ALL)) WHERE rank <= 20"""


_CLASS = "[^ \\t\\n\\x0b\\x0c\\r]+"
_UUID = lambda name: f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
  FROM (SELECT sha1(unhex('{NAMESPACE.replace("-", "")}') || encode({name})) AS h))"""  # noqa: E731
_HEADINGS = r"""(SELECT page_id AS doc, (i - 1)::INT AS idx, regexp_extract(h, '(?i)^<h([1-6])', 1)::INT AS level,
  trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0b\x0c\r]+', ' ', 'g')) AS title, (2 * (i - 1))::INT AS start
  FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS hs FROM pages)))"""
_PAGED = f"(SELECT *, max(start) OVER (PARTITION BY doc) + 3 AS n_pages FROM {_HEADINGS})"
_LINES = rf"(SELECT doc_id, source, lang, len(string_split(text, chr(10)))::INT AS n_lines, len(regexp_extract_all(text, '{_CLASS}'))::INT AS n_words FROM documents)"
_BLOCKS = """(SELECT conv_id, turn, turn // 3 AS page, conv_id || '_' || turn AS id, role,
  CASE WHEN role = 'assistant' OR turn % 5 = 4 THEN conv_id || '_' || (turn - 1) ELSE '' END AS parent_block_id FROM conversations)"""
_SNAP = """stored AS (SELECT doc_id AS guid, source AS owner, md5(text) AS digest FROM documents WHERE doc_id % 10 <> 3),
wanted AS (SELECT doc_id AS guid, source AS owner, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS digest FROM documents WHERE doc_id % 11 <> 5)"""


def _split(sections: str, most: int = 40) -> str:
    return f"""SELECT doc, level, {{more}} CASE WHEN n > 1 THEN title || ' (part ' || (k + 1) || '/' || n || ')' ELSE title END AS title, (start_page + k * {most})::INT AS start_page,
  (CASE WHEN k = n - 1 THEN end_page ELSE start_page + k * {most} + {most - 1} END)::INT AS end_page
FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, ceil((end_page - start_page + 1) / {most}.0)::BIGINT AS n FROM {sections}))"""


SQL: dict[str, str] = {
    "dense_topk": f"SELECT query_id, guid, round(cosine_distance, 9) AS cosine_distance, rank FROM ({_dense('vec_id = 0')})",
    "dense_topk_owner": f"SELECT query_id, guid, round(cosine_distance, 9) AS cosine_distance, rank FROM ({_dense('vec_id = 0', 'c.label = 3')})",
    "dense_topk_batch": f"SELECT query_id, guid, round(cosine_distance, 9) AS cosine_distance, rank FROM ({_dense('vec_id % 50 = 0')})",
    "dense_index": f"SELECT query_id, guid, round(cosine_distance, 9) AS cosine_distance, rank FROM ({_dense('vec_id % 50 = 0', 'c.label = 3')})",
    "dense_index_recall": f"""SELECT (SELECT count(*) FROM ({_dense('vec_id % 50 = 0')})) AS wanted, TRUE AS found_nine_of_ten,
  (SELECT min(n) FROM (SELECT query_id, count(*) AS n FROM ({_dense('vec_id % 50 = 0', 'c.label = 3')}) GROUP BY query_id)) AS fewest_of_owner""",
    "keyword_topk": f"SELECT query_id, guid, round(text_rank, 9) AS text_rank, rank FROM {_keyword(20)}",
    "keyword_index": f"SELECT query_id, guid, round(text_rank, 9) AS text_rank, rank FROM {_keyword(20, "(SELECT * FROM documents WHERE lang = 'en')")}",
    "keyword_stored": f"SELECT query_id, guid, round(text_rank, 9) AS text_rank, rank FROM {_keyword(20)}",
    "keyword_phrases": _phrases(),
    "inverted_index": f"SELECT term, count(DISTINCT guid) AS documents, sum(tf)::BIGINT AS occurrences FROM {_postings()} GROUP BY term",
    "rrf_hybrid": f"""WITH lists AS (
  SELECT query_id, guid, rank, 0 AS list FROM ({_dense('vec_id IN (SELECT item_id FROM benchmark)', 'c.vec_id IN (SELECT doc_id FROM documents)')}) UNION ALL SELECT query_id, guid, rank, 1 FROM {_keyword(20)}
), fused AS (
  SELECT query_id, guid, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, max(rank) FILTER (WHERE list = 0) AS dense_rank, max(rank) FILTER (WHERE list = 1) AS keyword_rank, min(list * 1000 + rank) AS first FROM lists GROUP BY ALL
) SELECT query_id, guid, round(rrf_score, 9) AS rrf_score, dense_rank, keyword_rank, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, guid)::INT AS rank FROM fused) WHERE rank <= 20""",
    "hybrid_pools": f"""WITH lists AS (
  SELECT query_id, guid, rank, 0 AS list FROM ({_dense('vec_id IN (SELECT item_id FROM benchmark)', 'c.vec_id IN (SELECT doc_id FROM documents)')}) UNION ALL SELECT query_id, guid, rank, 1 FROM {_keyword(20)}
), fused AS (
  SELECT query_id, guid, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, max(rank) FILTER (WHERE list = 0) AS dense_rank, max(rank) FILTER (WHERE list = 1) AS keyword_rank, min(list * 1000 + rank) AS first FROM lists GROUP BY ALL
) SELECT query_id, guid, round(rrf_score, 9) AS rrf_score, dense_rank, keyword_rank, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, guid)::INT AS rank FROM fused) WHERE rank <= 5""",
    "rrf_multi_query": f"""WITH fused AS (
  SELECT query_id // 4 AS question, guid, sum(1.0::DOUBLE / (60 + rank) ORDER BY query_id) AS rrf_score, min(query_id * 1000 + rank) AS first, count(*) AS n_lists FROM {_keyword(20)} GROUP BY ALL
) SELECT question AS query_id, guid, round(rrf_score, 9) AS rrf_score, n_lists, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY rrf_score DESC, first, guid)::INT AS rank FROM fused) WHERE rank <= 20""",
    "expand_parents": rf"""WITH c AS (SELECT k.*, guid - guid % 4 AS parent FROM {_keyword(20)} k),
g AS (SELECT query_id, parent, arg_min(guid, rank) AS guid, min(rank) AS best, count(*)::INT AS n_children FROM c GROUP BY ALL),
t AS (SELECT g.*, p.doc_id AS parent_guid, CASE WHEN length(p.text) <= 6000 THEN p.text ELSE regexp_replace(p.text[1:6000], '\s+$', '') || chr(10) || chr(10) || '...[parent chunk truncated for length]' END AS text
  FROM g JOIN documents p ON p.doc_id = g.parent)
SELECT query_id, guid, parent_guid, n_children, TRUE AS expanded_from_parent, md5(text) AS text_md5, length(text)::INT AS chars, row_number() OVER (PARTITION BY query_id ORDER BY best, parent_guid)::INT AS rank FROM t""",
    "rerank_overlap": f"""WITH c AS (SELECT k.query_id, k.guid, k.rank, list_distinct(regexp_extract_all(lower(b.text), '[a-z]+')) AS q, regexp_extract_all(lower(d.text), '[a-z]+') AS w
  FROM {_keyword(20)} k JOIN benchmark b ON b.item_id = k.query_id JOIN documents d ON d.doc_id = k.guid),
s AS (SELECT query_id, guid, rank AS retrieval_rank, len(list_intersect(q, w))::DOUBLE / len(q) AS s FROM c)
SELECT query_id, guid, round(s, 9) AS rerank_score, retrieval_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, retrieval_rank)::INT AS rank FROM s) WHERE rank <= 10""",
    "manual_override": f"""WITH c AS (SELECT f.*, CASE WHEN guid % 9 = 0 THEN label / 4.0::DOUBLE END AS manual_rank_score FROM ({_dense('vec_id % 50 = 0')}) f JOIN embeddings e ON e.vec_id = f.guid)
SELECT query_id, guid, round(cosine_distance, 9) AS cosine_distance, manual_rank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(-manual_rank_score, cosine_distance), rank)::INT AS rank FROM c""",
    "context_blocks": f"""SELECT query_id, md5(context) AS context_md5, length(context)::INT AS chars FROM (
  SELECT query_id, string_agg('[Excerpt ' || rank || ' -- ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM {_keyword(5)} k JOIN documents d ON d.doc_id = k.guid GROUP BY query_id)""",
    "lang_detect": f"""SELECT doc_id AS guid, CASE WHEN len(regexp_extract_all(text, '[\\x{{0400}}-\\x{{04ff}}]')) > 200 THEN 'ru'
  WHEN len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in T.FRENCH)}))) > len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in T.ENGLISH)}))) THEN 'fr' ELSE 'en' END AS detected
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents)""",
    "grounding_words": f"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM benchmark), n AS (SELECT max(item_id) + 1 AS n FROM benchmark),
p AS (SELECT doc_id AS guid, regexp_extract_all(lower(text), '[a-z'']+') AS a, doc_id % n.n AS item FROM documents, n),
e AS (SELECT guid, unnest(a) AS x, generate_subscripts(a, 1) AS i, item FROM p),
f AS (SELECT guid, x, min(i) AS i FROM e JOIN b ON b.item_id = e.item WHERE length(x) > 2 AND list_contains(w, x) AND x NOT IN ({', '.join("'" + x.replace("'", "''") + "'" for x in T.STOPWORDS)}) GROUP BY guid, x),
r AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY i) AS k FROM f)
SELECT guid, coalesce(string_agg(x, ' ' ORDER BY k) FILTER (WHERE k <= 12), '') AS words FROM p LEFT JOIN r USING (guid) GROUP BY guid""",
    "text_functions": r"""SELECT coalesce(page_id, doc_id) AS id, CASE WHEN s = '' THEN 'source' ELSE s END AS slug, md5(t) AS title_md5,
  (CASE WHEN length(text) <= 1000 THEN length(text) ELSE length(regexp_replace(text[1:1000], '\s+$', '')) + 40 END)::INT AS cut_chars,
  length(text) BETWEEN 1 AND 100 AND len(regexp_extract_all(text, '\p{L}')) >= 3 AND regexp_matches(text, '^[\p{Lu}\p{Lt}\p{Nd}]') AS heading
FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, trim(regexp_replace(translate(html, '<>/', '   '), '\s+', ' ', 'g')) AS t FROM pages) p
FULL JOIN documents d ON d.doc_id = p.page_id""",
    "qa_markup_check": r"""WITH s AS (SELECT page_id, replace(replace(html, '<p>', '[['), '</p>', ']]') AS src FROM pages),
o AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN replace(src, ']]', '') ELSE src END AS out FROM s),
n AS (SELECT *, greatest(length(regexp_replace(src, '\[\[|\]\]|</?sup>', '', 'g')), 1) AS plain FROM o)
SELECT page_id, len(regexp_extract_all(src, '\[\[')) = len(regexp_extract_all(out, '\[\[')) AND len(regexp_extract_all(src, '\]\]')) = len(regexp_extract_all(out, '\]\]')) AS marks_ok,
  len(regexp_extract_all(src, '<sup>')) = len(regexp_extract_all(out, '<sup>')) AS sup_ok, round_even(length(out)::DOUBLE / plain, 2) AS len_ratio FROM n""",
    "stable_ids": f"SELECT doc_id, {_UUID("'source:' || source || ':' || lang")} AS source_guid, {_UUID("'page:' || source || ':' || lang || ':' || doc_id")} AS page_guid FROM documents",
    "chunk_pack": rf"""WITH RECURSIVE l AS (
  SELECT doc_id, line, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, line, i, len(regexp_extract_all(line, '{_CLASS}')) AS tokens FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE line <> ''
), f AS (
  SELECT doc_id, i, tokens AS held, 0 AS ord FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN f.held + l.tokens > 500 THEN l.tokens ELSE f.held + l.tokens END, f.ord + CASE WHEN f.held + l.tokens > 500 THEN 1 ELSE 0 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1
)
SELECT doc_id AS guid, ord::INT AS ord, md5(string_agg(line, chr(10) ORDER BY i)) AS chunk_md5, sum(tokens)::INT AS tokens FROM f JOIN l USING (doc_id, i) GROUP BY doc_id, ord""",
    "outline_ends": f"SELECT doc, idx, start, greatest(coalesce(lead(start) OVER (PARTITION BY doc ORDER BY idx) - 1, n_pages - 1), start)::INT AS end_page FROM {_PAGED}",
    "level_ends": f"""WITH h AS (SELECT * FROM {_PAGED}), n AS (SELECT a.doc, a.idx, min(b.idx) AS nxt FROM h a JOIN h b ON a.doc = b.doc AND b.idx > a.idx AND b.level <= a.level GROUP BY ALL)
SELECT h.doc, h.idx, h.level, h.start, greatest(coalesce(b.start - 1, h.n_pages - 1), h.start)::INT AS end_page FROM h LEFT JOIN n USING (doc, idx) LEFT JOIN h b ON b.doc = n.doc AND b.idx = n.nxt""",
    "outline_sections": f"""SELECT doc, idx, level, title, start, end_page FROM (SELECT *, greatest(coalesce(lead(start) OVER (PARTITION BY doc ORDER BY idx) - 1, n_pages - 1), start)::INT AS end_page FROM {_PAGED} WHERE level BETWEEN 1 AND 2)
WHERE NOT regexp_full_match(title, 'A.*') AND regexp_full_match(title, '.*[a-m].*')""",
    "running_headers": f"SELECT title, count(DISTINCT doc) AS pages, count(*) AS times FROM {_HEADINGS} GROUP BY title",
    "heading_mode": f"SELECT doc, level AS mode FROM (SELECT doc, level, row_number() OVER (PARTITION BY doc ORDER BY sum(length(title)) DESC, min(idx)) AS k FROM {_HEADINGS} GROUP BY doc, level) WHERE k = 1",
    "page_ranges": """WITH p AS (SELECT DISTINCT user_id AS doc, date_diff('day', DATE '2020-01-01', ts::DATE) AS page FROM events),
i AS (SELECT doc, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM p) GROUP BY doc, g)
SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM i GROUP BY doc""",
    "link_sequence": f"""WITH b AS (SELECT * FROM {_BLOCKS}), m AS (SELECT *, row_number() OVER w AS number, lag(id) OVER w AS pid, lag(page) OVER w AS ppage, lead(id) OVER w AS nid FROM b WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY page, turn, id)),
k AS (SELECT parent_block_id AS id, string_agg(id, ',' ORDER BY number) AS kids FROM m WHERE parent_block_id <> '' GROUP BY 1)
SELECT m.id, m.number::INT AS number, CASE WHEN p.id IS NULL THEN '' ELSE p.id END AS parent_id, p.number::INT AS parent_number, CASE WHEN p.id IS NULL THEN 0 WHEN p.parent_block_id <> '' THEN 2 ELSE 1 END AS level,
  coalesce(m.pid, '') AS prev_id, coalesce(m.nid, '') AS next_id, CASE WHEN m.role = 'assistant' AND m.ppage = m.page - 1 THEN m.pid ELSE '' END AS continues_from, coalesce(kids, '') AS child_ids, TRUE AS is_translation_unit
FROM m LEFT JOIN m p ON p.id = m.parent_block_id LEFT JOIN k ON k.id = m.id
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM b WHERE role = 'system'""",
    "reading_offsets": "SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM conversations",
    "book_index": f"SELECT source AS source_key, lang AS language, count(*) AS page_count, sum(n_lines)::BIGINT AS blocks, sum(n_words)::BIGINT AS words, min(doc_id) AS first_page FROM {_LINES} GROUP BY ALL",
    "window_sections": f"""SELECT doc, 'Pages ' || (s + 1) || '-' || least(s + 10, n) AS title, 1 AS level, s::INT AS start_page, (least(s + 10, n) - 1)::INT AS end_page
FROM (SELECT doc_id AS doc, n_lines AS n, unnest(range(0, n_lines, 10)) AS s FROM {_LINES})""",
    "split_oversized": _split(f"(SELECT doc_id AS doc, source AS title, 1 AS level, 0 AS start_page, n_words - 1 AS end_page FROM {_LINES} WHERE n_words > 0)").replace("{more}", ""),
    "fallback_sections": _split(f"""(WITH l AS (SELECT doc_id AS doc, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
o AS (SELECT doc, i, i % 3 + 1 AS level, md5(line) AS title, n FROM l WHERE doc % 3 = 0),
k AS (SELECT doc, CASE WHEN count(*) FILTER (WHERE level <= 1) >= 5 THEN 1 WHEN count(*) FILTER (WHERE level <= 2) >= 5 THEN 2 WHEN count(*) >= 5 THEN 3 END AS depth FROM o GROUP BY doc),
h AS (SELECT doc, i, md5(line) AS title, n, count(*) OVER (PARTITION BY doc) AS c FROM l WHERE doc % 3 = 1 AND i > 0),
g AS (SELECT doc, i, title, n FROM h WHERE c >= 5 AND c <= n UNION ALL SELECT DISTINCT doc, 0, 'Front matter', n FROM h WHERE c >= 5 AND c <= n),
e AS (SELECT doc, title, level, i AS start_page, coalesce(lead(i) OVER (PARTITION BY doc ORDER BY i) - 1, n - 1) AS end_page, 'outline' AS strategy FROM o JOIN k USING (doc) WHERE level <= depth
UNION ALL SELECT doc, title, 1, i, coalesce(lead(i) OVER (PARTITION BY doc ORDER BY i) - 1, n - 1), 'headings' FROM g),
r AS (SELECT DISTINCT doc, n FROM l WHERE doc NOT IN (SELECT doc FROM e))
SELECT * FROM e UNION ALL SELECT doc, 'Pages ' || (s + 1) || '-' || least(s + 10, n), 1, s, least(s + 10, n) - 1, 'windows' FROM (SELECT doc, n, unnest(range(0, n, 10)) AS s FROM r))""").replace("{more}", "strategy,"),
    "sync_actions": f"WITH {_SNAP} SELECT guid, CASE WHEN s.digest IS NULL THEN 'insert' WHEN w.digest IS NULL THEN 'delete' ELSE 'update' END AS action FROM stored s FULL JOIN wanted w USING (guid) WHERE s.digest IS DISTINCT FROM w.digest",
    "upsert_snapshot": f"WITH {_SNAP} SELECT * FROM wanted UNION ALL SELECT * FROM stored WHERE guid NOT IN (SELECT guid FROM wanted)",
    "insert_absent": f"WITH {_SNAP} SELECT * FROM wanted WHERE guid NOT IN (SELECT guid FROM stored)",
    "source_summary": "SELECT source AS source_key, lang AS language, count(*) AS recognised_pages, min(doc_id) AS first_page, CASE WHEN lang = 'en' THEN max(doc_id) + 1 ELSE count(*) END AS page_count FROM documents GROUP BY source, lang",
    "translation_targets": """WITH p AS (SELECT DISTINCT source AS source_key, lang AS language FROM documents), l(language, ord) AS (VALUES ('fr', 1), ('en', 2), ('de', 3), ('es', 4), ('ru', 5)),
s AS (SELECT source_key, arg_min(language, ord) AS source_language FROM p JOIN l USING (language) GROUP BY source_key)
SELECT source_key, source_language, l.language FROM s, l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_key = s.source_key AND p.language = l.language)""",
    "catalog_attributes": f"""SELECT a.entity || '.' || a.attribute AS code, d.label, a.data_type, a.required, a.repeatable
FROM (VALUES {_values(catalog.ATTRIBUTES)}) AS a(entity, attribute, data_type, required, repeatable) JOIN (VALUES {_values(catalog.DEFINITIONS)}) AS d(code, label, model_entity, maps_to, parent) ON d.code = a.entity""",
    "catalog_taxonomy": f"""WITH d AS (SELECT * FROM (VALUES {_values([(*x, i + 1) for i, x in enumerate(catalog.DEFINITIONS)])}) AS d(code, label, model_entity, maps_to, parent, ord))
SELECT d.code, d.label, d.parent, p.label AS parent_label, d.ord FROM d LEFT JOIN d p ON p.code = d.parent""",
    "integrity_faults": "SELECT 'chunk without a page' AS fault, doc_id::VARCHAR AS guid FROM documents WHERE doc_id % 13 = 1",
    "box_owner": r"""WITH w AS (SELECT item_id AS page_id, (i - 1)::BIGINT AS word FROM (SELECT item_id, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS ws FROM benchmark))),
c AS (SELECT *, ((word // 10) * 0.03::DOUBLE + 0.05::DOUBLE + 0.02::DOUBLE / 2) * 800 AS cy FROM w),
b AS (SELECT page_id, unnest(range(0, floor(max(cy) / 20)::BIGINT + 1)) AS o FROM c GROUP BY page_id)
SELECT page_id, word, min(o)::INT AS block FROM c JOIN b USING (page_id) WHERE cy BETWEEN o * 20 + 29 AND o * 20 + 66 GROUP BY ALL""",
}
