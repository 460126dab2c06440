"""The queries of this subpackage and their SQL: thin digests of what the operators give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslices, chat, hilbert, hmm, huffman, interactions, mixing, neardup, packing, quality, suffixes, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"), neardup.Join(k=4))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.formatted(spark, rows))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans without the document that has them earlier: of several, which one the operator names depends on what it compared."""
    return suffixes.repeats(spark, _table(spark, sf_dir, "documents")).select("doc_id", "start", "n_words", "whole")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.apply_policy(quality.apply_policy(entries, "base", "base_kept"), "v1", "kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed_rules")


def op7_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_packages(spark, warc.write_packages(spark, _table(spark, sf_dir, "pages")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, _table(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_ids(spark, huffman.write_ids(spark, _table(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json")))


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return hmm.scored(spark, _table(spark, sf_dir, "documents"), held_out)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.search(spark, bitslices.index(spark, _table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_mixing_sources, op3_nearest_neighbours, op4_chat_formatting, op5_suffix_array_dedup, op6_quality_rules, op7_warc_packages, op8_toxicity, op9_packing, op10_token_ids, op11_hidden_markov, op12_filter_interactions, op13_bit_sliced_search, pipeline,
    )
}

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_WORD = "[^\\x20\\x09-\\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op2_mixing_sources": rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (ARRAY[5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM totals
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT source, source_size, coalesce(least(cap, max(level) FILTER (WHERE cap > level * w) OVER () * w), cap) AS target FROM levels
), ranked AS (
  SELECT s.doc_id, s.source, s.size, f.source_size, f.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS r,
    CASE WHEN f.source_size > 0 THEN f.target / f.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7:' || coalesce(s.source, chr(0))), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM sized s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN CAST(floor(start + r * rate) - floor(start + (r - 1) * rate) AS BIGINT) * size ELSE 0 END AS taken
FROM ranked
""",
    # the template's marks and control strings are fixed values of chat.DEFAULT
    "op4_chat_formatting": """
WITH probe(conv_id, turn, role, text) AS (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM probe)),
e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
    + list_sum(list_transform(['<<SYS>>', '<</SYS>>', '<s>', '[INST]', '[/INST]', '[OUT]', '</s>', '<<ROLE>>', '<</ROLE>>', '<<END>>'], lambda c: (length(text) - length(replace(text, c, ''))) // length(c)))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 9 ELSE 24 + length(role) END AS chars,
    lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE FALSE END)
    AND bool_and(after IS NOT NULL OR role IN ('assistant', 'user')) AS valid
FROM e GROUP BY conv_id
""",
    "op6_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM t)
), base AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(CASE WHEN regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]') THEN 1 ELSE 0 END) AS n_alpha
  FROM words GROUP BY rid
), grams AS (
  SELECT rid, p, w || chr(1) || lead(w) OVER q || chr(1) || lead(w, 2) OVER q AS g FROM words WINDOW q AS (PARTITION BY rid ORDER BY p)
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS k FROM grams WHERE g IS NOT NULL) WHERE k > 1
), repeated AS (
  SELECT rid, count(DISTINCT p + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_WORD}') GROUP BY rid
), ledger AS (
  SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_alpha, 0)::BIGINT AS n_alpha_words
  FROM t LEFT JOIN base USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN lines USING (rid)
), masked AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * word_chars < 25 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * word_chars > 120 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_alpha_words < 70 * n_words THEN 64 ELSE 0 END + CASE WHEN n_words > 100000 THEN 128 ELSE 0 END)::BIGINT AS failed_rules
  FROM ledger
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, (failed_rules & 127) = 0 AS kept, failed_rules
FROM masked
""",
    "op7_warc_packages": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
d AS (SELECT digest, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest, n)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN d.last IS NOT NULL AND p.page_id IS DISTINCT FROM d.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.last IS NOT NULL AND p.page_id IS DISTINCT FROM d.last THEN d.last END AS refers_to
FROM p LEFT JOIN d ON p.digest = d.digest AND p.n = d.n
""",
    # components of links by brute force: texts with equal sets are joined first, then sets that share a shingle
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_WORD}'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) END AS sh FROM t
), r AS (
  SELECT min(doc_id) AS id, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh
), e AS (
  SELECT id, n, unnest(sh) AS x FROM r
), links AS (
  SELECT a, b FROM (SELECT p.id AS a, q.id AS b, p.n AS m, q.n AS n, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.id < q.id GROUP BY ALL) WHERE 100 * k >= 80 * (m + n - k)
), ends AS (
  SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id AS u, id AS v FROM r WHERE id IN (SELECT u FROM ends) UNION SELECT reach.u, ends.v FROM reach JOIN ends ON reach.v = ends.u
), c AS (
  SELECT r.sh, coalesce(min(reach.v), min(r.id)) AS component FROM r LEFT JOIN reach ON reach.u = r.id GROUP BY r.sh
)
SELECT doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN doc_id ELSE c.component END AS component_id, len(s.sh) = 0 OR c.component = doc_id AS kept
FROM s LEFT JOIN c ON c.sh = s.sh
""",
    # all windows of 50 words; of equal texts the first stands for all
    "op5_suffix_array_dedup": rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), f AS (
  SELECT *, min(doc_id) OVER (PARTITION BY ws) AS first FROM t WHERE len(ws) >= 50
), w AS (
  SELECT doc_id, i AS p, array_to_string(ws[i + 1:i + 50], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM f WHERE doc_id = first)
), r AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM r)
)
SELECT doc_id, min(p)::BIGINT AS start, (max(p) - min(p) + 50)::BIGINT AS n_words, FALSE AS whole FROM g GROUP BY doc_id, g
UNION ALL SELECT doc_id, 0, len(ws)::BIGINT, TRUE FROM f WHERE doc_id <> first
""",
    # exact; the curves' windows hold all vectors of tables up to their width
    "op3_nearest_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
""",
    "op12_filter_interactions": rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, MAP {{
    'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), FALSE)}} AS f
  FROM t LEFT JOIN marks ON marks.doc_id = t.doc_id
), counted AS (
  SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY ALL
), l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s::INT AS step, substr(o, s, 1) AS own, string_split(substr(o, 1, s - 1), '') AS before FROM orders, range(1, 6) r(s)
), judged AS (
  SELECT part, o, step, own, n, good, toxic, f[own] AS here, len(list_filter(before, lambda b: coalesce(f[b], FALSE))) > 0 AS gone,
    f[own] AND len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda b: f[b])) = 1 AS alone
  FROM counted, steps
), summed AS (
  SELECT part, o AS filter_order, step, own, sum(CASE WHEN gone OR here THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN here AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN here AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed
""",
    "op13_bit_sliced_search": rf"""
WITH lower AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts FROM documents
  UNION ALL SELECT 'i', 0, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') FROM benchmark
), docs AS (
  SELECT rid, id, len(ts)::BIGINT AS n, ts FROM lower WHERE kind = 'd' AND len(ts) > 0
), totals AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs
), asked AS (
  SELECT id AS item_id, t, count(*)::BIGINT AS times FROM (SELECT id, unnest(ts) AS t FROM lower WHERE kind = 'i') GROUP BY ALL
), held AS (
  SELECT rid, id, n, t, count(*)::BIGINT AS tf FROM (SELECT rid, id, n, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY t
), scored AS (
  SELECT item_id, rid, id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM held JOIN weights USING (t) JOIN asked USING (t), totals GROUP BY ALL
), ranked AS (
  SELECT item_id, id AS doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id ASC NULLS LAST)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
