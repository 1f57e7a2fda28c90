"""SQL answers to the registered queries, for DuckDB on the same tables.

Written from the definitions, in relational form; blocks are CTEs shared by
several answers.
"""

from __future__ import annotations

from functools import reduce

from rankweave.functions import text

DIM = 64
WORD = r"[^\p{L}\p{N}]+"


def stop_list(language: str) -> list[str]:
    return list(text.stop_words(language))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def stop_set(language: str) -> str:
    return f"({quoted(stop_list(language))})"


def token_list(column: str, pattern: str = WORD) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '{pattern}'), lambda x: x <> '')"


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in blocks) + "\n"


# Items

RAW_ITEMS = """
raw_items AS (
  SELECT p_partkey AS item_key,
    CASE WHEN p_size % 13 <> 0 THEN p_partkey END AS id,
    CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 7 <> 0 THEN p_name END AS title,
    CASE WHEN p_size % 5 <> 0 THEN p_brand || ' ' || p_type END AS overview,
    CASE WHEN p_size % 3 <> 0 THEN [p_type, p_brand] END AS genres,
    CASE WHEN p_size % 9 = 0 THEN '' WHEN p_size % 4 <> 0 THEN 'https://img/' || p_partkey END AS poster,
    CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 6 <> 0
         THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 END AS release_date
  FROM part LEFT JOIN orders ON p_partkey = o_orderkey)
"""
ITEMS = RAW_ITEMS.rstrip() + """,
items AS (
  SELECT item_key,
    coalesce(id, (SELECT coalesce(max(id), 0) FROM raw_items)
             + row_number() OVER (PARTITION BY id IS NULL ORDER BY item_key)) AS id,
    coalesce(title, 'Unknown') AS title, coalesce(overview, '') AS overview,
    coalesce(genres, []) AS genres, poster, release_date
  FROM raw_items)
"""
YEAR = "CASE WHEN release_date <> 0 THEN year(DATE '1970-01-01' + CAST(floor(release_date / 86400) AS INTEGER)) END"
CONTENT_HEAD = f"""'title: ' || title, 'year: ' || CAST({YEAR} AS VARCHAR),
  CASE WHEN len(genres) > 0 THEN 'genres: ' || array_to_string(genres, ', ') END,
  CASE WHEN overview NOT IN ('', '0') THEN 'overview: ' || overview END"""
PAYLOAD = """
turns AS (SELECT conv_id AS item_id, turn, role, text FROM conversations),
kw AS (
  SELECT item_id, list(text ORDER BY turn) AS keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn) AS n FROM turns WHERE role <> 'system')
  WHERE n <= 15 GROUP BY item_id),
cast8 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn) AS n FROM turns) WHERE n <= 8),
named AS (
  SELECT item_id, n * 2 AS place, role AS name FROM cast8
  UNION ALL
  SELECT item_id, n * 2 + 1, trim(regexp_replace(text || ' (voice) ' || role, '\\s*\\([^)]*\\)\\s*', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13) || chr(11)) FROM cast8),
first_named AS (
  SELECT item_id, name, min(place) AS place FROM named WHERE name NOT IN ('', '0') GROUP BY item_id, name),
chars AS (SELECT item_id, list(name ORDER BY place) AS characters FROM first_named GROUP BY item_id),
dir AS (SELECT item_id, arg_min(text, turn) AS director FROM turns WHERE role = 'assistant' GROUP BY item_id),
reduced AS (
  SELECT t.item_id, coalesce(keywords, []) AS keywords, coalesce(characters, []) AS characters, director
  FROM (SELECT DISTINCT item_id FROM turns) t
  LEFT JOIN kw USING (item_id) LEFT JOIN chars USING (item_id) LEFT JOIN dir USING (item_id))
"""

# Text. Stems come from the distinct vocabulary, one CTE per step.

def suffix_case(rules: dict[str, str]) -> str:
    return "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"


def stem_blocks(vocabulary: str, name: str = "stem") -> str:
    """CTEs ending in `name`(term, stem) for a relation with a `term`."""
    m0, m1, e1, vowel, cvc = text.M_GT_0, text.M_GT_1, text.M_EQ_1, text.HAS_VOWEL, text.CVC
    has = lambda s, p: f"regexp_matches({s}, '{p}')"
    cut = lambda s, n=1: f"left({s}, length({s}) - {n})"

    def listed(rules):
        pattern = "^(.+?)(" + "|".join(rules) + ")$"
        stem, suffix = (f"regexp_extract(w, '{pattern}', {i})" for i in (1, 2))
        new = suffix_case(rules).replace("CASE x", f"CASE {suffix}")
        return f"CASE WHEN {suffix} <> '' AND {has(stem, m0)} THEN {stem} || {new} ELSE w END"

    ed = "regexp_extract(w, '^(.+?)(?:ed|ing)$', 1)"
    last4 = "regexp_extract(w, '^(.+?)(?:" + "|".join(text.STEP4) + ")$', 1)"
    ion = "regexp_extract(w, '^(.+?[st])ion$', 1)"
    m = cut("w")
    steps = [
        "CASE WHEN w LIKE 'y%' THEN 'Y' || substr(w, 2) ELSE w END",
        f"CASE WHEN length(w) < 3 OR w NOT LIKE '%s' OR w LIKE '%ss' THEN w WHEN w LIKE '_%sses' OR w LIKE '_%ies' THEN {cut('w', 2)} ELSE {m} END",
        f"CASE WHEN w LIKE '_%eed' THEN CASE WHEN {has(cut('w', 3), m0)} THEN {m} ELSE w END "
        f"WHEN {ed} <> '' AND {has(ed, vowel)} THEN {ed} || '+' ELSE w END",
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN {has(m, '(?:at|bl|iz)$')} THEN {m} || 'e' "
        f"WHEN {has(m, text.DOUBLE)} THEN {cut('w', 2)} WHEN {has(m, e1)} AND {has(m, cvc)} THEN {m} || 'e' ELSE {m} END",
        f"CASE WHEN w LIKE '__%y' AND {has(m, vowel)} THEN {m} || 'i' ELSE w END",
        listed(text.STEP2),
        listed(text.STEP3),
        f"CASE WHEN {last4} <> '' THEN CASE WHEN {has(last4, m1)} THEN {last4} ELSE w END "
        f"WHEN {has(ion, m1)} THEN {ion} ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({has(m, m1)} OR ({has(m, e1)} AND NOT {has(m, cvc)})) THEN {m} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {has('w', m1)} THEN {m} ELSE w END",
        "CASE WHEN w LIKE 'Y%' THEN 'y' || substr(w, 2) ELSE w END",
    ]
    out = [f"{name}0 AS (SELECT DISTINCT term, term AS w FROM {vocabulary})"]
    for i, step in enumerate(steps, 1):
        out.append(f"{name}{i} AS (SELECT term, {step} AS w FROM {name}{i - 1})")
    out.append(f"{name} AS (SELECT term, w AS stem FROM {name}{len(steps)})")
    return ",\n".join(out)


def english_tokens(name: str, source: str, key: str, column: str) -> str:
    """`name`(key, pos, term): stop words gone, positions kept, stems."""
    return f"""{name}_list AS (SELECT {key}, unnest(list_transform({token_list(column)}, lambda x, i: {{'term': x, 'pos': i}})) AS t FROM {source}),
{name}_raw AS (SELECT {key}, t.pos AS pos, t.term AS term FROM {name}_list WHERE t.term NOT IN {stop_set('en')}),
{stem_blocks(name + '_raw', name + '_stem')},
{name} AS (SELECT {key}, pos, stem AS term FROM {name}_raw JOIN {name}_stem USING (term))"""


DOC_TOKENS = english_tokens("doc_tok", "documents", "doc_id", "text")
POSTINGS = DOC_TOKENS + """,
postings AS (SELECT doc_id, term, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM doc_tok GROUP BY ALL),
doc_len AS (SELECT doc_id, sum(tf) AS doc_len FROM postings GROUP BY ALL),
term_df AS (SELECT term, count(*) AS df FROM postings GROUP BY ALL),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(tf) FROM postings) / (SELECT count(*) FROM documents) AS avg_len)"""

SEARCH_QUERIES = """
queries AS (SELECT item_id AS query_id, text AS q, embedding AS query_vec FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""
SENTENCES = """
queries AS (
  SELECT item_id || '-' || (s.i - 1) AS query_id, s.q AS q FROM (
    SELECT item_id, unnest(list_transform(regexp_split_to_array(text, '[.\n]+'), lambda x, i: {'q': x, 'i': i})) AS s FROM benchmark))"""


def query_terms(source: str = "queries") -> str:
    return english_tokens("q_tok", source, "query_id", "q") + """,
q_terms AS (SELECT DISTINCT query_id, term FROM q_tok),
q_size AS (SELECT query_id, count(*) AS n_terms FROM q_terms GROUP BY ALL)"""


BM25_SCORES = """
bm25 AS (
  SELECT query_id, doc_id, round(sum(
    ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 6) AS score
  FROM q_terms JOIN postings USING (term) JOIN term_df USING (term) JOIN doc_len USING (doc_id), corpus
  GROUP BY query_id, doc_id)"""

MATCHED = """
matched AS (
  SELECT query_id, doc_id, round(sum(tf / (tf + 1.0::DOUBLE)) / any_value(n_terms), 6) AS score
  FROM q_terms JOIN q_size USING (query_id) JOIN postings USING (term)
  GROUP BY query_id, doc_id HAVING count(*) = any_value(n_terms))"""


def top(name: str, source: str, k: int | None, score: str = "score", direction: str = "DESC") -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} {direction}, doc_id) AS rank FROM {source}"
    return f"{name} AS ({ranked})" if k is None else f"{name} AS (SELECT * FROM ({ranked}) WHERE rank <= {k})"


DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
COSINE = f"{DOT} / (sqrt({DOT.format('{0}', '{0}')}) * sqrt({DOT.format('{1}', '{1}')}))"
SIMILAR = f"""
near_by AS (
  SELECT query_id, vec_id AS doc_id, round({COSINE.format('query_vec', 'embedding')}, 6) AS score
  FROM queries, embeddings WHERE query_vec IS NOT NULL)"""

HYBRID = ",\n".join([SEARCH_QUERIES, POSTINGS, query_terms(), BM25_SCORES, top("lexical", "bm25", 100), SIMILAR, top("semantic", "near_by", 100)])


def fused(name: str, parts: dict[str, str], scale: str = "1100.0::DOUBLE", digits: int = 6) -> str:
    rows = " UNION ALL ".join(
        f"SELECT query_id, doc_id, {weight} AS weight, rank FROM {source}" for source, weight in parts.items())
    return f"""{name} AS (
  SELECT query_id, doc_id, round({scale} * sum(weight / (10 + rank)), {digits}) AS score
  FROM ({rows}) WHERE weight > 0 GROUP BY query_id, doc_id)"""


RRF = {"lexical": "(1 - 0.3::DOUBLE)", "semantic": "0.3::DOUBLE"}

# Fuzzy

def trigram_block(name: str, source: str, column: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT {column}, substr('  ' || {column} || ' ', i, 3) AS trigram
  FROM (SELECT {column}, unnest(range(1, length({column}) + 2)) AS i FROM {source}))"""


SIMPLE_TOKENS = f"simple AS (SELECT doc_id, unnest({token_list('text')}) AS term FROM documents)"
VOCABULARY = "vocabulary AS (SELECT DISTINCT term FROM simple)"
FUZZY_PAIRS = ",\n".join([
    f"q_words AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest({token_list('q')}) AS word FROM queries))",
    "words AS (SELECT DISTINCT word FROM q_words)",
    SIMPLE_TOKENS, VOCABULARY, trigram_block("wg", "words", "word"), trigram_block("tg", "vocabulary", "term"),
    """pairs AS (
  SELECT word, term, shared / (nw + nt - shared) AS similarity
  FROM (SELECT word, term, count(*) AS shared FROM wg JOIN tg USING (trigram) GROUP BY ALL)
  JOIN (SELECT word, count(*) AS nw FROM wg GROUP BY ALL) USING (word)
  JOIN (SELECT term, count(*) AS nt FROM tg GROUP BY ALL) USING (term)
  WHERE shared / (nw + nt - shared) >= 0.2::DOUBLE)""",
])
FUZZY_SCORES = """
best AS (SELECT word, doc_id, max(similarity) AS similarity FROM pairs JOIN (SELECT DISTINCT doc_id, term FROM simple) USING (term) GROUP BY ALL),
fuzzy_all AS (
  SELECT query_id, doc_id, round(sum(similarity) / any_value(n), 6) AS score
  FROM q_words JOIN (SELECT query_id, count(*) AS n FROM q_words GROUP BY ALL) USING (query_id) JOIN best USING (word)
  GROUP BY query_id, doc_id)"""

# Hash embedding

def embed_blocks(name: str, source: str, key: str, column: str, dim: int = DIM) -> str:
    """`name`(key, pos, value): nonzero entries of the unit vector."""
    return f"""{name}_t AS (SELECT {key}, unnest({token_list(column)}) AS term FROM {source}),
{name}_s AS (
  SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS pos,
    sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS total
  FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(total * total)::DOUBLE) AS length FROM {name}_s GROUP BY ALL),
{name} AS (
  SELECT {key}, pos, CAST(total / length AS FLOAT) AS value FROM {name}_s JOIN {name}_n USING ({key})
  WHERE total <> 0)"""


ITEM_FIELDS = """
item_text AS (
  SELECT p_partkey AS doc_id, 'title' AS field, p_name AS text FROM part
  UNION ALL SELECT p_partkey, 'overview', p_brand || ' ' || p_type FROM part
  UNION ALL SELECT p_partkey, 'genres', p_type FROM part),
""" + f"""
item_tok AS (SELECT doc_id, field, unnest({token_list('text')}) AS term FROM item_text),
item_post AS (SELECT doc_id, field, term, count(*) AS tf FROM item_tok GROUP BY ALL),
item_len AS (SELECT doc_id, field, count(*) AS doc_len FROM item_tok GROUP BY ALL),
item_avg AS (SELECT field, count(*) / (SELECT count(*) FROM part) AS avg_len FROM item_tok GROUP BY ALL),
item_df AS (SELECT field, term, count(*) AS df FROM item_post GROUP BY ALL),
names AS (SELECT DISTINCT p_name AS query_id, p_name AS q FROM part),
name_terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({token_list('q')}) AS term FROM names))
"""


def item_bm25(name: str, boost: str) -> str:
    return f"""{name} AS (
  SELECT query_id, doc_id, round(sum({boost} *
    ln(1 + ((SELECT count(*) FROM part) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 6) AS score
  FROM name_terms JOIN item_post USING (term) JOIN item_df USING (field, term) JOIN item_len USING (doc_id, field)
  JOIN item_avg USING (field) GROUP BY query_id, doc_id)"""


ITEM_HITS = ",\n".join([RAW_ITEMS, ITEM_FIELDS, item_bm25("item_scores", "1"), top("item_hits", "item_scores", 20)])
BOOST = "CASE field WHEN 'title' THEN 0.9::DOUBLE WHEN 'overview' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END"

RAW_QUERIES = """
raw_queries AS (
  SELECT item_id AS query_id,
    CASE WHEN item_id % 7 = 3 THEN '' WHEN item_id % 11 = 5 THEN '0' ELSE text END AS q,
    CASE item_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.45 ELSE 0.3 END::DOUBLE AS semantic_ratio,
    CASE item_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 12 WHEN 2 THEN 150 ELSE 20 END::BIGINT AS "limit"
  FROM benchmark),
prepared AS (SELECT *, q NOT IN ('', '0') AS accepted FROM raw_queries)"""

WEIGHTED = """
both_sides AS (
  SELECT query_id, doc_id, coalesce(k.score, 0) * 0.5::DOUBLE AS weighted_keyword_score,
    coalesce(v.score, 0) * 0.5::DOUBLE AS weighted_semantic_score
  FROM (SELECT * FROM matched WHERE query_id IN (SELECT query_id FROM queries WHERE query_vec IS NOT NULL)) k
  FULL JOIN semantic v USING (query_id, doc_id)),
weighted_all AS (
  SELECT *, weighted_keyword_score + weighted_semantic_score AS total_score FROM both_sides
  UNION ALL
  SELECT query_id, doc_id, score, 0.0, score FROM matched WHERE query_id IN (SELECT query_id FROM queries WHERE query_vec IS NULL))"""

# Cover density: for every right end, each term's last position up to it; the
# oldest of these starts the cover, and only the shortest cover per start counts.
COVERS = """
hits AS (SELECT DISTINCT query_id, doc_id, term, pos FROM matched JOIN q_terms USING (query_id) JOIN doc_tok USING (doc_id, term)),
lasts AS (
  SELECT r.query_id, r.doc_id, r.pos, l.term, max(l.pos) AS last FROM hits r
  JOIN hits l ON r.query_id = l.query_id AND r.doc_id = l.doc_id AND l.pos <= r.pos GROUP BY ALL),
ends AS (
  SELECT query_id, doc_id, pos, min(last) AS start FROM lasts JOIN q_size USING (query_id)
  GROUP BY query_id, doc_id, pos HAVING count(*) = any_value(n_terms)),
covers AS (SELECT query_id, doc_id, start, min(pos) AS stop FROM ends GROUP BY ALL),
native AS (SELECT query_id, doc_id, round(sum(least(1.0::DOUBLE, 16.0::DOUBLE / (stop - start + 1))), 6) AS score FROM covers GROUP BY ALL)"""

NEIGHBOURS = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
EPOCH = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400"
BUILT_VECTOR = "list_transform(embedding, lambda x: CAST(round(x::DOUBLE, 6) AS DECIMAL(9,6)))"
VECTOR_TEXT = f"'[' || array_to_string({BUILT_VECTOR}, ',') || ']'"
LANG_STOP = " ".join(f"WHEN '{c}' THEN term NOT IN {stop_set(c)}" for c in ("en", "fr", "de", "es"))
LIGHT = " ".join(
    "WHEN '{}' THEN {}".format(code, _nested) for code, _nested in (
        (c, reduce(
            lambda inner, rule: f"regexp_replace({inner}, '{rule[0]}', '\\1{rule[1]}')", text.LIGHT_RULES[text.full_language(c)], "term"))
        for c in ("fr", "de", "es")))
HITS = 'query_id, doc_id, rank, score'


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    item_out = "item_key, id, title, overview, array_to_string(genres, '|') AS genres, poster, release_date"
    q["load_items"] = with_(RAW_ITEMS) + "SELECT id, title, overview, array_to_string(genres, '|') AS genres, poster, release_date FROM raw_items"
    q["item_defaults"] = with_(ITEMS) + f"SELECT {item_out} FROM items"
    q["import_limit"] = with_(ITEMS) + "SELECT id, title FROM items ORDER BY id LIMIT 50"
    q["corpus_upsert"] = """SELECT doc_id, text AS content FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
        UNION ALL SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'second: ' ELSE '' END || text FROM benchmark"""
    q["delete_by_metadata"] = """SELECT event_id, CASE WHEN event_type <> 'error' THEN props END AS metadata FROM events
        WHERE event_type = 'error' OR json_extract_string(props, '$.k') <> '69'"""
    q["incremental_import"] = """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'new ' ELSE '' END || p_name AS title, p_brand AS overview, p_type AS genres
        FROM part WHERE p_size % 9 <> 0"""
    problem = "CASE WHEN p_size % 13 = 0 THEN 'id' WHEN p_size % 7 = 0 THEN 'genres' WHEN p_size % 5 = 0 THEN 'release_date' END"
    q["refused_rows"] = "SELECT 'bad ' || p_partkey AS title, 'id' AS problem FROM part WHERE p_size % 9 = 0"
    q["load_items_array"] = "SELECT p_partkey AS id, p_name AS title, p_brand AS overview, p_type AS genres FROM part"
    q["quarantine_rows"] = f"SELECT 'p' || p_partkey AS poster, {problem} AS problem FROM part WHERE {problem} IS NOT NULL"
    q["import_report"] = f"SELECT count(*) AS total, count({problem}) AS errors FROM part"
    q["content_document"] = with_(ITEMS, PAYLOAD) + f"""SELECT item_key, concat_ws(chr(10), {CONTENT_HEAD},
        CASE WHEN len(keywords) > 0 THEN 'keywords: ' || array_to_string(keywords, ', ') END,
        CASE WHEN len(characters) > 0 THEN 'characters: ' || array_to_string(characters, ', ') END,
        CASE WHEN director NOT IN ('', '0') THEN 'director: ' || director END) AS content
        FROM items LEFT JOIN reduced ON id = item_id"""
    q["metadata_pack"] = with_(ITEMS) + f"""SELECT item_key, CAST(json_object('text', concat_ws(chr(10), {CONTENT_HEAD}), 'title', title,
        'overview', overview, 'genres', genres, 'poster', poster, 'release_date', release_date, 'movie_id', id) AS VARCHAR) AS metadata FROM items"""
    q["metadata_unpack"] = """SELECT p_partkey AS item_key, CASE WHEN p_size % 7 = 0 AND p_size % 5 <> 0 THEN NULL ELSE p_partkey END AS tmdb_id,
        p_name AS title, CAST(NULL AS VARCHAR) AS overview, '["' || p_type || '","' || p_brand || '"]' AS genres,
        CAST(NULL AS VARCHAR) AS poster, CAST(p_size AS BIGINT) AS release_date, p_size % 7 = 0 AND p_size % 5 <> 0 AS cast_failed
        FROM part WHERE p_size % 3 <> 0"""
    q["release_year"] = f"""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '5-LOW' THEN NULL
        WHEN '2-HIGH' THEN year(DATE '1970-01-01' - CAST(({EPOCH}) // 86400 AS INTEGER))
        ELSE year(CAST(o_orderdate AS DATE)) END AS BIGINT) AS year FROM orders"""
    q["vector_format"] = f"SELECT vec_id, {VECTOR_TEXT} AS text FROM embeddings"
    q["vector_parse"] = f"""WITH t AS (
        SELECT vec_id, unnest(CASE label WHEN 0 THEN [0.0] WHEN 1 THEN [NULL] WHEN 2 THEN [NULL] WHEN 3 THEN [1.5, 0.0, -20.0]
          ELSE {BUILT_VECTOR}::DOUBLE[] END::DOUBLE[]) AS value,
          generate_subscripts(CASE label WHEN 0 THEN [0] WHEN 1 THEN [0] WHEN 2 THEN [0] WHEN 3 THEN [0, 0, 0] ELSE embedding END, 1) - 1 AS pos, label
        FROM embeddings)
        SELECT vec_id, CASE WHEN label IN (1, 2) THEN NULL ELSE pos END AS pos, value FROM t"""
    q["vector_validate"] = "SELECT vec_id, label NOT IN (0, 1) AND len(embedding) = 64 AS valid FROM embeddings"
    q["genres_normalise"] = """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type || '|' || p_brand
        WHEN p_size % 5 <> 0 THEN p_type ELSE '' END AS genres FROM part"""
    q["doc_identity"] = "SELECT doc_id, sha256(source || ':' || doc_id) AS key FROM documents"
    q["query_prepare"] = with_(RAW_QUERIES) + 'SELECT query_id, q, semantic_ratio, "limit", accepted FROM prepared'
    hit = "coalesce(title, 'Unknown')"
    q["hit_projection"] = with_(ITEM_HITS) + f"""SELECT {HITS}, {hit} AS title, coalesce(overview, '') AS overview,
        coalesce(array_to_string(genres, '|'), '') AS genres, poster, release_date FROM item_hits JOIN raw_items ON item_key = doc_id"""
    q["result_cards"] = with_(ITEM_HITS) + f"""SELECT query_id, doc_id, {hit} AS title, coalesce(array_to_string(genres[1:3], '|'), '') AS genres,
        CASE WHEN poster <> '' THEN poster ELSE 'https://via.placeholder.com/200x300?text=No+Poster' END AS poster,
        CASE WHEN rank % 2 = 0 THEN printf('%.3f', score) ELSE 'N/A' END AS score
        FROM item_hits JOIN raw_items ON item_key = doc_id"""
    q["bm25_fielded"] = with_(ITEM_FIELDS, item_bm25("s", BOOST), top("t", "s", 20)) + f"SELECT {HITS} FROM t"

    q["enrich_keywords"] = with_(PAYLOAD) + "SELECT item_id, array_to_string(keywords, '|') AS keywords FROM reduced"
    q["enrich_characters"] = with_(PAYLOAD) + "SELECT item_id, array_to_string(characters, '|') AS characters FROM reduced"
    q["enrich_director"] = with_(PAYLOAD) + "SELECT item_id, director FROM reduced"
    q["clean_role"] = """SELECT conv_id, turn, CASE WHEN octet_length(encode(bare)) > 1 THEN bare END AS role FROM (
        SELECT conv_id, turn, trim(regexp_replace(CASE turn WHEN 0 THEN role || ' (voice) ' || text WHEN 1 THEN '(uncredited)' WHEN 2 THEN 'X'
          ELSE text || ' (as himself)' END, '\\s*\\([^)]*\\)\\s*', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13) || chr(11)) AS bare FROM conversations)"""
    q["enrich_join"] = with_(RAW_ITEMS, PAYLOAD) + """SELECT item_key, coalesce(len(keywords), 0) AS n_keywords,
        coalesce(len(characters), 0) AS n_characters, director FROM raw_items LEFT JOIN reduced ON id = item_id"""

    q["tokenize"] = f"""SELECT doc_id, t.pos AS pos, t.term AS term FROM (
        SELECT doc_id, unnest(list_transform({token_list('text')}, lambda x, i: {{'term': x, 'pos': i}})) AS t FROM documents)"""
    lang_tokens = f"lang_tok AS (SELECT doc_id, lang, unnest({token_list('text')}) AS term FROM documents)"
    kept = f"kept AS (SELECT * FROM lang_tok WHERE CASE lang {LANG_STOP} ELSE TRUE END)"
    q["stopword_filter"] = with_(lang_tokens, kept) + "SELECT doc_id, term, count(*) AS n FROM kept GROUP BY doc_id, term"
    q["tokenize_by_lang"] = with_(lang_tokens, kept, stem_blocks("kept")) + f"""
        SELECT doc_id, CASE lang WHEN 'en' THEN stem {LIGHT} ELSE term END AS term, count(*) AS n
        FROM kept JOIN stem USING (term) GROUP BY ALL"""
    q["stem_vocabulary"] = with_(SIMPLE_TOKENS, VOCABULARY, stem_blocks("vocabulary")) + "SELECT term, stem FROM stem"
    q["term_frequency"] = with_(POSTINGS) + "SELECT doc_id, term, tf, CAST(doc_len AS BIGINT) AS doc_len, positions FROM postings JOIN doc_len USING (doc_id)"
    q["bm25_stats"] = with_(POSTINGS) + "SELECT term, df, n_docs, round(avg_len, 6) AS avg_len FROM term_df, corpus"
    q["token_options"] = f"""SELECT page_id, array_to_string({token_list('url', '[^/=a-df-z0-9]+')}, '|') AS tokens FROM pages"""

    words = with_(SENTENCES, POSTINGS, query_terms(), MATCHED)
    q["fts_match"] = words + "SELECT query_id, doc_id FROM matched"
    q["keyword_search"] = with_(SENTENCES, POSTINGS, query_terms(), MATCHED, top("t", "matched", 20)) + f"SELECT {HITS} FROM t"
    q["keyword_search_items"] = with_(
        "queries AS (SELECT DISTINCT p_name AS query_id, p_name AS q FROM part)",
        "item_full AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part)",
        english_tokens("it", "item_full", "doc_id", "text"),
        "postings AS (SELECT doc_id, term, count(*) AS tf FROM it GROUP BY ALL)", query_terms(), MATCHED, top("t", "matched", 20)) + f"SELECT {HITS} FROM t"
    q["native_search"] = with_(SENTENCES, POSTINGS, query_terms(), MATCHED, COVERS, top("t", "native", 20)) + f"SELECT {HITS} FROM t"
    final = """
final_docs AS (
  SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
  UNION ALL SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'second: ' ELSE '' END || text FROM benchmark),
kept_docs AS (SELECT * FROM final_docs WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src7'))"""
    q["bm25_incremental"] = with_(SEARCH_QUERIES, final, POSTINGS.replace("FROM documents", "FROM kept_docs"), query_terms(), BM25_SCORES,
                                  top("t", "bm25", 20)) + f"SELECT {HITS} FROM t"
    q["bm25_search"] = with_(SEARCH_QUERIES, POSTINGS, query_terms(), BM25_SCORES, top("t", "bm25", 20)) + f"SELECT {HITS} FROM t"
    q["bm25_top_k"] = q["bm25_search"]  # skipping must not change an answer
    q["hit_counts"] = with_(SEARCH_QUERIES, POSTINGS, query_terms(), BM25_SCORES, top("t", "bm25", 20)) + "SELECT query_id, count(doc_id) AS hits FROM queries LEFT JOIN t USING (query_id) GROUP BY query_id"
    q["infix_search"] = "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tioner')"
    q["infix_indexed"] = """WITH needles AS (
        SELECT item_id * 2 AS needle_id, lower(substring(text, 11, 8)) AS needle FROM benchmark
        UNION ALL SELECT item_id * 2 + 1, lower(substring(text, 3, 2)) FROM benchmark)
      SELECT needle_id, doc_id FROM needles JOIN documents ON contains(lower(text), needle)
      WHERE needle IS NOT NULL AND needle <> ''"""
    q["title_lookup"] = "SELECT p_partkey, p_name AS title FROM part WHERE p_name = 'red widget'"

    q["trigrams"] = with_(SIMPLE_TOKENS, VOCABULARY, trigram_block("tg", "vocabulary", "term")) + "SELECT term, trigram FROM tg"
    q["fuzzy_terms"] = with_(SEARCH_QUERIES, FUZZY_PAIRS) + "SELECT word, term, round(similarity, 6) AS similarity FROM pairs"
    q["fuzzy_search"] = with_(SEARCH_QUERIES, FUZZY_PAIRS, FUZZY_SCORES, top("t", "fuzzy_all", 20)) + f"SELECT {HITS} FROM t"

    q["hash_embed"] = with_(embed_blocks("e", "documents", "doc_id", "text")) + "SELECT doc_id, pos, round(value::DOUBLE, 6) AS value FROM e"
    q["hash_embed_fields"] = with_("d AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part)",
                                   embed_blocks("e", "d", "doc_id", "text")) + "SELECT doc_id, pos, round(value::DOUBLE, 6) AS value FROM e"
    a, b = "a.embedding", "b.embedding"
    pair = lambda e: f"SELECT a.vec_id AS vec_id, round({e}, 6) AS value FROM {NEIGHBOURS}"
    q["cosine_similarity"] = q["cosine_sql_udf"] = pair(COSINE.format(a, b))
    q["l2_distance"] = pair(f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])")
    q["inner_product"] = pair(DOT.format(a, b))
    vec = with_(SEARCH_QUERIES, SIMILAR, top("t", "near_by", 20))
    q["vector_search"] = q["vector_search_cells_full"] = vec + f"SELECT {HITS} FROM t"
    q["vector_search_cells"] = with_(SEARCH_QUERIES, f"""
        size AS (SELECT greatest(4, floor(sqrt(count(*)))::BIGINT // 4) AS n FROM embeddings),
        centers AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding AS center FROM embeddings
          QUALIFY row_number() OVER (ORDER BY vec_id) <= (SELECT n FROM size)),
        placed AS (SELECT vec_id, embedding, arg_max(cell, (near, -cell)) AS cell FROM (
          SELECT vec_id, embedding, cell, round({COSINE.format('embedding', 'center')}, 6) AS near FROM embeddings, centers) GROUP BY ALL),
        probed AS (SELECT query_id, query_vec, cell FROM (
          SELECT query_id, query_vec, cell, row_number() OVER (PARTITION BY query_id ORDER BY round({COSINE.format('query_vec', 'center')}, 6) DESC, cell) AS place
          FROM queries, centers WHERE query_vec IS NOT NULL) WHERE place <= (SELECT (3 * n + 9) // 10 FROM size)),
        near_by AS (SELECT query_id, vec_id AS doc_id, round({COSINE.format('query_vec', 'embedding')}, 6) AS score FROM probed JOIN placed USING (cell))""",
        top("t", "near_by", 20)) + f"SELECT {HITS} FROM t"
    q["vector_search_l2"] = with_(SEARCH_QUERIES, """far AS (SELECT query_id, vec_id AS doc_id,
        round(list_distance(query_vec::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM queries, embeddings WHERE query_vec IS NOT NULL)""",
        top("t", "far", 20, direction="ASC")) + f"SELECT {HITS} FROM t"
    q["vector_within"] = with_(SEARCH_QUERIES, SIMILAR, "near AS (SELECT * FROM near_by WHERE score >= 1 - 0.7::DOUBLE)", top("t", "near", 20)) + f"SELECT {HITS} FROM t"

    some = SEARCH_QUERIES.replace("embedding AS query_vec", "CASE WHEN item_id % 3 <> 0 THEN embedding END AS query_vec")
    w = "query_id, doc_id, rank, weighted_keyword_score, weighted_semantic_score, total_score"
    tail = (POSTINGS, query_terms(), MATCHED, SIMILAR, top("semantic", "near_by", 100), WEIGHTED, top("t", "weighted_all", 20, "total_score"))
    q["hybrid_fallback"] = with_(some, *tail) + f"SELECT {w} FROM t"
    q["hybrid_weighted"] = with_(SEARCH_QUERIES, *tail) + f"SELECT {w}, lang, source FROM t LEFT JOIN documents USING (doc_id)"
    q["hybrid_rrf"] = with_(HYBRID, fused("f", RRF), top("t", "f", 20)) + f"SELECT {HITS} FROM t"
    sweep = """ratios AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS r),
        lex_at AS (SELECT query_id || '@' || r AS query_id, doc_id, rank, 1 - r AS weight FROM lexical, ratios),
        sem_at AS (SELECT query_id || '@' || r AS query_id, doc_id, rank, r AS weight FROM semantic, ratios)"""
    q["rrf_ratio_sweep"] = with_(HYBRID, sweep, fused("f", {"lex_at": "weight", "sem_at": "weight"}), top("t", "f", 20)) + f"SELECT {HITS} FROM t"
    q["hybrid_rrf_fuzzy"] = with_(HYBRID, FUZZY_PAIRS, FUZZY_SCORES, top("fuzzy", "fuzzy_all", 100),
        fused("f", {"lexical": "0.6::DOUBLE * (1 - 0.3::DOUBLE)", "semantic": "0.6::DOUBLE * 0.3::DOUBLE", "fuzzy": "0.4::DOUBLE"}), top("t", "f", 20)) + f"SELECT {HITS} FROM t"
    q["normalized_scores"] = with_(HYBRID, fused("f", RRF), fused("r", RRF, "1.0::DOUBLE", 9)) + \
        "SELECT query_id, doc_id, f.score AS score, r.score AS raw_score FROM f JOIN r USING (query_id, doc_id)"
    q["min_score_filter"] = with_(HYBRID, fused("f", RRF), "kept AS (SELECT * FROM f WHERE score >= CASE WHEN query_id % 4 = 0 THEN 10 ELSE 30 END)",
                                  top("t", "kept", 20)) + f"SELECT {HITS} FROM t"
    share = lambda name: f"round(1100.0::DOUBLE * ({RRF[name]} / (10 + {name}.rank)), 6)"
    q["score_breakdown"] = with_(HYBRID, fused("f", RRF), top("t", "f", 20)) + f"""
        SELECT t.query_id, t.doc_id, t.rank, t.score, lexical.rank AS lexical_rank, lexical.score AS lexical_score, {share('lexical')} AS lexical_contribution,
          semantic.rank AS semantic_rank, semantic.score AS semantic_score, {share('semantic')} AS semantic_contribution
        FROM t LEFT JOIN lexical ON lexical.query_id = t.query_id AND lexical.doc_id = t.doc_id
        LEFT JOIN semantic ON semantic.query_id = t.query_id AND semantic.doc_id = t.doc_id"""
    q["rrf_vector_only"] = with_(SEARCH_QUERIES, SIMILAR, top("semantic", "near_by", 100), fused("f", {"semantic": "1.0::DOUBLE"}), top("t", "f", 20)) + f"SELECT {HITS} FROM t"
    q["compare_strategies"] = with_(HYBRID, MATCHED, COVERS, top("native20", "native", 20), fused("f", RRF), top("hybrid20", "f", 20),
        """every AS (SELECT query_id, doc_id, rank, 'bm25' AS s FROM lexical WHERE rank <= 20
             UNION ALL SELECT query_id, doc_id, rank, 'semantic' FROM semantic WHERE rank <= 20
             UNION ALL SELECT query_id, doc_id, rank, 'native' FROM native20
             UNION ALL SELECT query_id, doc_id, rank, 'hybrid' FROM hybrid20)""") + """
        , names(s) AS (VALUES ('bm25'), ('semantic'), ('native'), ('hybrid')),
        found AS (SELECT query_id, x.s AS a, y.s AS b, count(*) AS n, avg(abs(x.rank - y.rank)) AS gap
          FROM every x JOIN every y USING (query_id, doc_id) WHERE x.s < y.s GROUP BY query_id, x.s, y.s)
        SELECT query_id, a AS left_strategy, b AS right_strategy, coalesce(n, 0) AS shared,
          round(coalesce(n, 0) / 20, 6) AS overlap, round(gap, 6) AS mean_rank_gap
        FROM (SELECT query_id, l.s AS a, r.s AS b FROM queries, names l, names r WHERE l.s < r.s) LEFT JOIN found USING (query_id, a, b)"""

    q["coverage_report"] = with_(RAW_ITEMS) + "SELECT count(*) AS total, count(id) AS with_id, count(title) AS with_title, count(overview) AS with_overview FROM raw_items"
    q["facet_genres"] = with_(RAW_ITEMS) + "SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM raw_items) GROUP BY genre"
    q["facet_year"] = with_(RAW_ITEMS) + f"SELECT {YEAR} AS year, count(*) AS n FROM raw_items GROUP BY 1"
    q["sort_by_field"] = "SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars, doc_id"
    q["index_pipeline"] = with_(ITEMS, PAYLOAD) + f"""SELECT sha256('part:' || id) AS doc_id, id AS item_id, md5(concat_ws(chr(10), {CONTENT_HEAD},
        CASE WHEN len(keywords) > 0 THEN 'keywords: ' || array_to_string(keywords, ', ') END,
        CASE WHEN len(characters) > 0 THEN 'characters: ' || array_to_string(characters, ', ') END,
        CASE WHEN director NOT IN ('', '0') THEN 'director: ' || director END)) AS content_md5, TRUE AS embedded
        FROM items LEFT JOIN reduced ON id = item_id WHERE overview NOT IN ('', '0')"""
    accepted = "queries AS (SELECT query_id, q, semantic_ratio, \"limit\" FROM prepared WHERE accepted)"
    q["retrieve_batch"] = with_(
        RAW_QUERIES, accepted, POSTINGS, query_terms(), BM25_SCORES, top("lexical", "bm25", 150),
        embed_blocks("de", "documents", "doc_id", "text"), embed_blocks("qe", "queries", "query_id", "q"),
        """norms AS (SELECT doc_id, sqrt(sum(value::DOUBLE * value::DOUBLE)) AS n FROM de GROUP BY ALL),
        q_norms AS (SELECT query_id, sqrt(sum(value::DOUBLE * value::DOUBLE)) AS n FROM qe GROUP BY ALL),
        all_pairs AS (SELECT query_id, doc_id, x.n * y.n AS n FROM norms x, q_norms y),
        dots AS (SELECT query_id, doc_id, sum(de.value::DOUBLE * qe.value::DOUBLE) AS dot FROM de JOIN qe USING (pos) GROUP BY query_id, doc_id),
        near_by AS (SELECT query_id, doc_id, round(coalesce(dot, 0) / n, 6) AS score FROM all_pairs LEFT JOIN dots USING (query_id, doc_id))""",
        top("semantic", "near_by", 150),
        """lex_w AS (SELECT l.*, 1 - semantic_ratio AS weight FROM lexical l JOIN queries USING (query_id) WHERE rank <= greatest(100, "limit")),
        sem_w AS (SELECT s.*, semantic_ratio AS weight FROM semantic s JOIN queries USING (query_id) WHERE rank <= greatest(100, "limit"))""",
        fused("f", {"lex_w": "weight", "sem_w": "weight"}), top("t", "f", None)) + """
        SELECT query_id, t.doc_id, rank, score, source AS title, lang AS overview
        FROM t JOIN queries USING (query_id) JOIN documents ON documents.doc_id = t.doc_id WHERE rank <= "limit\""""
    return q
