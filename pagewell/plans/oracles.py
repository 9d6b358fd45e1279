"""SQL that computes each registered query's result independently, over the whole tables.

Written for DuckDB; the views are the given tables. Where a query has no entry
here, its docstring or the tests say how it is checked.
"""

from __future__ import annotations

from pagewell.operators.answers import EMPTY_QUESTION, ERROR_PREFIX, REFUSAL
from pagewell.operators.embedding import SLOTS
from pagewell.operators.prompts import PROMPT_HEAD, PROMPT_MIDDLE, PROMPT_TAIL, SYSTEM_MESSAGE

# Fixed values, written out here so that a wrong pattern in the engine shows.
SPACE = r"[\x09-\x0D ]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"([.!?])[\x09-\x0D ]+"
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
HIDDEN_BLOCK = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]*>"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def turn_id(turn: str = "turn") -> str:
    return f"-1 - ((conv_id + {turn}) * (conv_id + {turn} + 1) // 2 + {turn})"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda w: w <> '')"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{NOT_WORD}'), lambda t: t <> '')"


def sentences(text: str) -> str:
    return f"string_split_regex(regexp_replace({text}, '{SENTENCE_END}', '\\1' || chr(10), 'g'), '\\n+')"


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


def chunk_ctes(size: int, overlap: int) -> str:
    return f"""
doc_words AS (SELECT doc_id, {words('text')} AS w FROM documents),
chunk_starts AS (
  SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1 - {overlap}, 0) + 1, {size - overlap})) AS s
  FROM doc_words WHERE len(w) > 0),
chunks AS MATERIALIZED (
  SELECT doc_id, CAST(s // {size - overlap} AS INTEGER) AS chunk_no,
         array_to_string(w[s + 1 : s + {size}], ' ') AS chunk_text,
         CAST(least({size}, len(w) - s) AS INTEGER) AS n_tokens
  FROM chunk_starts)"""


CHUNKS = chunk_ctes(128, 28)

# Occurrences, idf per hash slot (whole ten-thousandths), and one component per place.
VECTORS = f"""
occ AS MATERIALIZED (
  SELECT doc_id, chunk_no, token, count(*) AS tf
  FROM (SELECT doc_id, chunk_no, unnest({tokens('chunk_text')}) AS token FROM chunks)
  GROUP BY ALL),
lens AS MATERIALIZED (
  SELECT doc_id, chunk_no, len({tokens('chunk_text')}) AS n_terms FROM chunks),
totals AS MATERIALIZED (
  SELECT count(*)::DOUBLE AS n, sum(n_terms)::DOUBLE / count(*) AS avg_len FROM lens),
hashed AS MATERIALIZED (
  SELECT token, ('0x' || substr(md5(token), 1, 7))::BIGINT AS h
  FROM (SELECT DISTINCT token FROM occ)),
slot_df AS (
  SELECT h % {SLOTS} AS slot, least(count(*), any_value(n))::DOUBLE AS df
  FROM occ JOIN hashed USING (token), totals GROUP BY h % {SLOTS}),
weights AS MATERIALIZED (
  SELECT slot, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 10000) AS weight
  FROM slot_df, totals),
vec AS MATERIALIZED (
  SELECT doc_id, chunk_no, CAST(h % 384 AS INTEGER) AS place,
         CAST(sum(tf * weight) / 10000 AS FLOAT)::DOUBLE AS x
  FROM occ JOIN hashed USING (token) JOIN weights ON weights.slot = h % {SLOTS}
  GROUP BY ALL),
norms AS MATERIALIZED (
  SELECT doc_id, chunk_no, coalesce(sqrt(sum(x * x)), 0) AS norm
  FROM chunks LEFT JOIN vec USING (doc_id, chunk_no) GROUP BY ALL)"""

# The same, with weights counted on the English documents only; what they lack weighs most.
GROWN_VECTORS = (
    VECTORS.replace("FROM lens),\nhashed", "FROM lens JOIN documents USING (doc_id) WHERE lang = 'en'),\nhashed")
    .replace("FROM occ JOIN hashed USING (token), totals", "FROM occ JOIN hashed USING (token) JOIN documents USING (doc_id), totals WHERE lang = 'en'")
    .replace("sum(tf * weight)", "sum(tf * coalesce(weight, (SELECT round(ln(1 + (n + 0.5::DOUBLE) / 0.5::DOUBLE) * 10000) FROM totals)))")
    .replace("JOIN hashed USING (token) JOIN weights", "JOIN hashed USING (token) LEFT JOIN weights")
)

BENCHMARK = "asked AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
USER_TURNS = (
    f"asked AS (SELECT {turn_id()} AS query_id, text AS query_text "
    "FROM conversations WHERE role = 'user')"
)

QUESTION_VECTORS = f"""
asked_occ AS MATERIALIZED (
  SELECT query_id, token, count(*) AS tf
  FROM (SELECT query_id, unnest({tokens('query_text')}) AS token FROM asked) GROUP BY ALL),
qvec AS MATERIALIZED (
  SELECT query_id, CAST(h % 384 AS INTEGER) AS place,
         CAST(sum(tf * coalesce(weight, most)) / 10000 AS FLOAT)::DOUBLE AS x
  FROM (SELECT *, ('0x' || substr(md5(token), 1, 7))::BIGINT AS h FROM asked_occ)
  LEFT JOIN (SELECT slot, weight FROM weights) known ON known.slot = h % {SLOTS},
  (SELECT round(ln(1 + (n + 0.5::DOUBLE) / 0.5::DOUBLE) * 10000) AS most FROM totals) GROUP BY ALL),
qnorm AS (SELECT query_id, sqrt(sum(x * x)) AS norm FROM qvec GROUP BY ALL)"""

BM25 = """
term_df AS (SELECT token, count(*)::DOUBLE AS df FROM occ GROUP BY ALL),
question_terms AS MATERIALIZED (
  SELECT query_id, token, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf
  FROM (SELECT DISTINCT query_id, token FROM asked_occ) JOIN term_df USING (token), totals),
bm25 AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_no,
         round(sum(idf * tf * 2.2::DOUBLE
               / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms / avg_len))), 4) AS score
  FROM occ JOIN question_terms USING (token) JOIN lens USING (doc_id, chunk_no), totals
  GROUP BY ALL)"""


def ranked(name: str, source: str, k: int) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_no, score, CAST(rank AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (
          PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM {source})
  WHERE rank <= {k})"""


COSINE = """
cosine AS MATERIALIZED (
  SELECT query_id, v.doc_id, v.chunk_no, round(sum(q.x * v.x) / (any_value(qn.norm) * any_value(cn.norm)), 4) AS score
  FROM qvec q JOIN vec v USING (place) JOIN qnorm qn USING (query_id)
  JOIN norms cn ON cn.doc_id = v.doc_id AND cn.chunk_no = v.chunk_no
  GROUP BY query_id, v.doc_id, v.chunk_no
  UNION ALL
  SELECT query_id, n.doc_id, n.chunk_no, 0
  FROM qnorm, norms n
  WHERE n.norm > 0 AND NOT EXISTS (
    SELECT 1 FROM qvec q JOIN vec v USING (place)
    WHERE q.query_id = qnorm.query_id AND v.doc_id = n.doc_id AND v.chunk_no = n.chunk_no))"""


def retrieval(asked: str, mode: str, candidate_k: int = 100, top_n: int = 3) -> list[str]:
    """CTEs up to ``hits``: candidates by mode, reranked by BM25."""
    ctes = [CHUNKS, VECTORS, asked, QUESTION_VECTORS, BM25]
    parts = []
    if mode in ("vector", "union"):
        ctes += [COSINE, ranked("by_vector", "cosine", candidate_k)]
        parts.append("SELECT query_id, doc_id, chunk_no FROM by_vector")
    if mode in ("bm25", "union"):
        ctes.append(ranked("by_bm25", "bm25", candidate_k))
        parts.append("SELECT query_id, doc_id, chunk_no FROM by_bm25")
    ctes.append(f"found AS ({' UNION '.join(parts)})")
    ctes.append(
        "rescored AS (SELECT bm25.* FROM found JOIN bm25 USING (query_id, doc_id, chunk_no))"
    )
    ctes.append(ranked("hits", "rescored", top_n))
    return ctes


HIT_TEXTS = """
hit_texts AS (
  SELECT hits.*, chunk_text, n_tokens, query_text
  FROM hits JOIN chunks USING (doc_id, chunk_no) JOIN asked USING (query_id))"""


def budget(num_ctx: int = 1024) -> str:
    frame = f"{lit(PROMPT_HEAD)} || {lit(PROMPT_MIDDLE)} || query_text || {lit(PROMPT_TAIL)}"
    return f"""
kept AS MATERIALIZED (
  SELECT * REPLACE (CAST(least(n_tokens, room) AS INTEGER) AS n_tokens,
    CASE WHEN n_tokens > room THEN array_to_string({words('chunk_text')}[1:room], ' ') ELSE chunk_text END AS chunk_text)
  FROM (SELECT *, CAST({num_ctx} - 128 - len({words(frame)}) - coalesce(sum(n_tokens) OVER (
          PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS room
        FROM hit_texts)
  WHERE room > 0)"""


def context(source: str) -> str:
    return f"""
contexts AS (
  SELECT query_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM {source} GROUP BY query_id)"""


PROMPTS = f"""
prompts AS (
  SELECT query_id, {lit(PROMPT_HEAD)} || coalesce(context, '') || {lit(PROMPT_MIDDLE)}
         || query_text || {lit(PROMPT_TAIL)} AS prompt
  FROM asked LEFT JOIN contexts USING (query_id))"""

BEST_SENTENCES = f"""
split_sentences AS (
  SELECT query_id, rank, {tokens('query_text')} AS asked_tokens,
         list_filter(list_transform({sentences('chunk_text')},
                     lambda s: array_to_string({words('s')}, ' ')), lambda s: s <> '') AS ss
  FROM kept),
each_sentence AS (
  SELECT query_id, rank, asked_tokens, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos
  FROM split_sentences),
scored_sentence AS (
  SELECT *, CAST(len(list_distinct(list_filter({tokens('sentence')},
            lambda t: list_contains(asked_tokens, t)))) AS INTEGER) AS overlap
  FROM each_sentence),
best AS MATERIALIZED (
  SELECT query_id, sentence AS answer, overlap FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, pos) AS r
    FROM scored_sentence) WHERE r = 1)"""


def capped(n: int) -> str:
    return f"array_to_string({words('answer')}[1:{n}], ' ')"


def answered(min_overlap: int = 1) -> str:
    return f"""
answered AS (
  SELECT query_id, CASE WHEN overlap >= {min_overlap} THEN {capped(128)}
                        ELSE {lit(REFUSAL)} END AS answer
  FROM asked LEFT JOIN best USING (query_id))"""


def context_ctes(
    asked: str = BENCHMARK, top_n: int = 3, num_ctx: int = 1024, mode: str = "union"
) -> list[str]:
    return [*retrieval(asked, mode, 100, top_n), HIT_TEXTS, budget(num_ctx)]


def answer_ctes(asked: str = BENCHMARK, min_overlap: int = 1, mode: str = "union") -> list[str]:
    return [*context_ctes(asked, mode=mode), BEST_SENTENCES, answered(min_overlap)]


def packed(size: int, overlap: int) -> str:
    """Sentences packed one after the other by a recursion over each document."""
    limit = size - overlap
    return f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest({sentences('text')}) AS s, unnest(range(len({sentences('text')}))) AS sno
  FROM documents),
sw AS (SELECT doc_id, sno, {words('s')} AS w FROM raw),
cut AS (SELECT doc_id, sno, w, unnest(range(0, greatest(len(w), 1), {limit})) AS o FROM sw),
pieces AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sno, o) AS i,
         array_to_string(w[o + 1 : o + {limit}], ' ') AS s, len(w[o + 1 : o + {limit}]) AS n
  FROM cut WHERE len(w) > 0),
fold AS (
  SELECT doc_id, i, n AS used, 0 AS chunk_no FROM pieces WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN f.used + p.n <= {limit} THEN f.used + p.n ELSE p.n END,
         CASE WHEN f.used + p.n <= {limit} THEN f.chunk_no ELSE f.chunk_no + 1 END
  FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
placed AS MATERIALIZED (
  SELECT doc_id, i, s, n, chunk_no,
         sum(n) OVER (PARTITION BY doc_id, chunk_no ORDER BY i DESC) AS from_end
  FROM fold JOIN pieces USING (doc_id, i)),
members AS (
  SELECT doc_id, chunk_no, i, s, n FROM placed
  UNION ALL
  SELECT doc_id, chunk_no + 1, i, s, n FROM placed p
  WHERE from_end <= {overlap} AND EXISTS (
    SELECT 1 FROM placed x WHERE x.doc_id = p.doc_id AND x.chunk_no = p.chunk_no + 1))
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, string_agg(s, ' ' ORDER BY i) AS chunk_text,
       CAST(sum(n) AS INTEGER) AS n_tokens
FROM members GROUP BY ALL"""


def page_text_sql(html: str) -> str:
    text = html
    for pattern in (HIDDEN_BLOCK, COMMENT, TAG):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    for entity, char in ENTITIES:
        text = f"replace({text}, {lit(entity)}, {lit(char)})"
    return f"trim(regexp_replace({text}, '{SPACE}', ' ', 'g'))"


LINES = "SELECT lang, length(text) AS n_chars, md5(text) AS text_md5 FROM documents{where}"

INFO = """
SELECT '{name}' AS name, count(*) AS points, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
       CAST(max(len(embedding)) AS INTEGER) AS max_dim, 'cosine' AS distance FROM embeddings"""

INDEX_ROWS = with_(
    CHUNKS,
    VECTORS,
    body="""
SELECT doc_id, chunk_no, n_tokens, CAST(n_terms AS INTEGER) AS n_terms, round(norm, 3) AS norm
FROM chunks JOIN lens USING (doc_id, chunk_no) JOIN norms USING (doc_id, chunk_no)""",
)

PAIRS = """
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         round(list_dot_product(q.e, c.e) / (q.norm * c.norm), 4) AS score
  FROM v q, v c{where})"""

UNIT = """
v AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""

BEST_PAIRS = """
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs) WHERE rank <= {k}"""


def approximate(bits: int, probes: int, dim: int, k: int) -> str:
    """The chunk's cell must be among the question's cheapest cells."""
    return with_(
        UNIT,
        f"""
planes AS (
  SELECT b, list(CASE WHEN ('0x' || substr(md5(b || ':' || i), 1, 7))::BIGINT % 2 = 1
                      THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS p
  FROM range({bits}) bs(b), range({dim}) ds(i) GROUP BY b),
side AS MATERIALIZED (
  SELECT vec_id, b, list_dot_product(e, p) / norm AS d FROM v, planes),
cell AS (
  SELECT vec_id, sum(CASE WHEN d > 0 THEN 1 << b ELSE 0 END) AS cell FROM side GROUP BY vec_id),
cost AS (
  SELECT vec_id, m, round(sum(CASE WHEN (m >> b) & 1 = 1 THEN abs(d) ELSE 0 END), 9) AS cost
  FROM side, range({1 << bits}) ms(m) GROUP BY vec_id, m),
visits AS MATERIALIZED (
  SELECT vec_id, xor(cell::BIGINT, m) AS cell FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, m) AS r FROM cost)
  JOIN cell USING (vec_id) WHERE r <= {probes}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         round(list_dot_product(q.e, c.e) / (q.norm * c.norm), 4) AS score
  FROM visits JOIN cell ON cell.cell = visits.cell
  JOIN v q ON q.vec_id = visits.vec_id JOIN v c ON c.vec_id = cell.vec_id)""",
        body=BEST_PAIRS.format(k=k),
    )


RANKS = "SELECT query_id, doc_id, chunk_no, score, rank FROM hits"


def quality_sql() -> str:
    ctes = retrieval(BENCHMARK, "union")
    modes = (("vector", "by_vector"), ("bm25", "by_bm25"), ("two_stage", "hits"))
    tables = " UNION ALL ".join(
        f"SELECT '{mode}' AS mode, query_id, doc_id, rank FROM {table}" for mode, table in modes
    )
    return with_(
        *ctes,
        "truth AS (SELECT query_id, doc_id FROM asked, documents WHERE contains(text, query_text))",
        f"every AS ({tables})",
        "best_rank AS (SELECT mode, query_id, doc_id, min(rank) AS rank FROM every GROUP BY ALL)",
        """
wanted AS (
  SELECT m.mode, t.query_id, t.doc_id, b.rank
  FROM truth t CROSS JOIN (VALUES ('vector'), ('bm25'), ('two_stage')) m(mode)
  LEFT JOIN best_rank b ON b.mode = m.mode AND b.query_id = t.query_id AND b.doc_id = t.doc_id),
per_q AS (
  SELECT mode, query_id, min(rank) AS first, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r1,
         avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS r3 FROM wanted GROUP BY ALL)""",
        body="""
SELECT mode, count(*) AS n_questions,
       round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_1,
       round(avg(r1), 4) AS recall_at_1,
       round(avg(CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_3,
       round(avg(r3), 4) AS recall_at_3, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr
FROM per_q GROUP BY mode""",
    )


ALL_TURNS = (
    f"every_turn AS (SELECT {turn_id()} AS query_id, "
    "CASE WHEN role = 'user' THEN text END AS query_text FROM conversations),\n"
    "asked AS (SELECT * FROM every_turn WHERE query_text IS NOT NULL)"
)

CACHE = f"""
WITH q AS (
  SELECT {turn_id()} AS query_id, text FROM conversations WHERE role = 'user'),
a AS (
  SELECT {turn_id("(turn - 1)")} AS query_id, text AS answer
  FROM conversations WHERE role = 'assistant'),
cache AS (
  SELECT md5(trim(lower(text))) AS key, arg_min(answer, query_id) AS answer
  FROM q JOIN a USING (query_id) GROUP BY ALL),
every AS (SELECT * FROM q UNION ALL SELECT item_id, text FROM benchmark)
SELECT query_id, answer, key IS NOT NULL AS hit
FROM every LEFT JOIN cache ON key = md5(trim(lower(text)))"""

MEASURED = """
measured AS (
  SELECT doc_id, chunk_no, length(chunk_text) AS chars,
         length(chunk_text) - length(replace(chunk_text, ' ', '')) + 1 AS blanks,
         length(chunk_text) - length(replace(chunk_text, '.', '')) AS stops FROM chunks)"""
MEASURES = """
SELECT doc_id, chunk_no, CAST(chars AS INTEGER) AS chars, CAST(blanks AS INTEGER) AS blanks,
       CAST(stops AS INTEGER) AS stops,
       round(sqrt((chars * chars + blanks * blanks + stops * stops)::DOUBLE), 3) AS norm
FROM measured"""


ORACLES = {
    "S1_recursive_folder_scan": LINES.format(where=""),
    "S2_flat_folder_scan": LINES.format(where=" WHERE lang = 'en'"),
    "S3_suffix_routing": LINES.format(where="") + """
UNION ALL SELECT '' AS lang, length(text) AS n_chars, md5(text) AS text_md5
FROM (SELECT """ + page_text_sql("html") + """ AS text FROM pages)""",
    "S1_folder_stream": with_(
        CHUNKS.replace(
            "FROM documents",
            f"FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - page_id, {page_text_sql('html')} FROM pages)",
        ),
        body="SELECT chunk_no, n_tokens, md5(chunk_text) AS text_md5, "
        "(SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS n_files FROM chunks",
    ),
    "S4_filename_as_id": """
SELECT true AS ids_unique, true AS names_match, count(*) AS n_files FROM documents""",
    "S5_missing_folder": """
SELECT 'lang=en' AS folder, count(*) AS n_files, '' AS error FROM documents WHERE lang = 'en'
UNION ALL SELECT 'lang=fr', count(*), '' FROM documents WHERE lang = 'fr'
UNION ALL SELECT 'absent', 0, 'Directory not found: /absent'""",
    "S6_page_text": f"SELECT page_id, url, {page_text_sql('html')} AS text FROM pages",
    "S7_list_documents": "SELECT text FROM documents",
    "S8_count_documents": "SELECT count(*) AS n_documents FROM documents",
    "S9_questions": f"""
SELECT item_id AS query_id, text AS query_text FROM benchmark
UNION ALL
SELECT {turn_id()}, text FROM conversations WHERE role = 'user'""",
    "S10_open_collection": with_(CHUNKS, body="SELECT doc_id, chunk_no, chunk_text FROM chunks"),
    "K1_list_collections": with_(
        CHUNKS,
        body="SELECT 'documents' AS name, count(*) AS points, count(*) > 0 AS documents_exists, "
        "false AS absent_exists FROM chunks",
    ),
    "K2_create_if_missing": INFO.format(name="vectors"),
    "K3_recreate": INFO.format(name="vectors"),
    "K4_build_index": INDEX_ROWS,
    "K5_append": with_(UNIT, body="SELECT vec_id AS doc_id, round(norm, 4) AS norm FROM v"),
    "K6_collection_info": INFO.format(name="embeddings"),
    "K7_drop_collection": (
        "SELECT count(*) AS points, true AS kept_exists, false AS dropped_exists FROM embeddings"
    ),
    "K8_vector_schema": """
SELECT CAST(dim AS INTEGER) AS dim,
       len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AS valid, vec_id
FROM embeddings, (VALUES (64), (384)) d(dim)""",
    "K9_json": f"""
SELECT '{{"name":"' || name || '","points":' || points || ',"min_dim":' || min_dim
       || ',"max_dim":' || max_dim || ',"distance":"' || distance || '"}}' AS json
FROM ({INFO.format(name='embeddings')})""",
    "K10_build_status": with_(
        CHUNKS,
        body="""
SELECT 'success' AS status, 'Index created successfully' AS message, count(*) AS points,
       count(DISTINCT doc_id) AS documents FROM chunks""",
    ),
    "T1_fixed_chunks": with_(
        chunk_ctes(1024, 200), body="SELECT doc_id, chunk_no, chunk_text, n_tokens FROM chunks"
    ),
    "T2_sentence_packing": packed(824, 0),
    "T3_sentence_overlap": packed(1024, 200),
    "T4_paragraphs": """
SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS para_no, unnest(ps) AS para_text
FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)""",
    "T5_embed_chunks": with_(
        CHUNKS,
        VECTORS,
        body="SELECT doc_id, chunk_no, place, round(x, 2) AS x FROM vec WHERE round(x, 2) > 0",
    ),
    "T6_encoder_slot": with_(chunk_ctes(1024, 200), MEASURED, body=MEASURES),
    "T3_T6_sql_functions": with_(f"chunks AS ({packed(1024, 200)})", MEASURED, body=MEASURES),
    "T1_S6_sql_functions": with_(
        f"documents AS (SELECT page_id AS doc_id, {page_text_sql('html')} AS text FROM pages)",
        CHUNKS,
        body="SELECT doc_id AS page_id, chunk_no, n_tokens, md5(chunk_text) AS text_md5 FROM chunks",
    ),
    "T7_unit_vectors": with_(
        UNIT,
        body="""
SELECT vec_id, round(norm, 4) AS norm, CAST(unnest(range(len(e))) AS INTEGER) AS place,
       round(unnest(e) / norm, 4) + 0 AS x FROM v""",
    ),
    "T8_tokens": f"""
SELECT doc_id, token, count(*) AS n
FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY ALL""",
    "R1_cosine_top_k": with_(UNIT, PAIRS.format(where=""), body=BEST_PAIRS.format(k=5)),
    "R2_approximate_top_k": approximate(8, 192, 64, 5),
    "R2_learned_cells": """
SELECT count(*) AS questions, true AS recall_reached, true AS at_most_a_quarter_read FROM embeddings
WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0""",
    "R3_embed_questions": with_(
        CHUNKS,
        VECTORS,
        BENCHMARK,
        QUESTION_VECTORS,
        body="SELECT query_id, place, round(x, 2) AS x FROM qvec WHERE round(x, 2) > 0",
    ),
    "R4_rerank": with_(*retrieval(BENCHMARK, "vector", 50, 3), body=RANKS),
    "R4_reranker_slot": with_(
        CHUNKS,
        VECTORS,
        BENCHMARK,
        QUESTION_VECTORS,
        COSINE,
        ranked("by_vector", "cosine", 100),
        """
by_length AS (
  SELECT query_id, doc_id, chunk_no, -abs(length(query_text) - length(chunk_text))::DOUBLE AS score
  FROM by_vector JOIN asked USING (query_id) JOIN chunks USING (doc_id, chunk_no))""",
        ranked("hits", "by_length", 3),
        body=RANKS,
    ),
    "R4_bm25_search": with_(
        CHUNKS, VECTORS, BENCHMARK, QUESTION_VECTORS, BM25, ranked("hits", "bm25", 3), body=RANKS
    ),
    "R5_two_stage": with_(*retrieval(BENCHMARK, "vector"), body=RANKS),
    "R6_retrieval_only": with_(
        *retrieval(BENCHMARK, "union"), body="SELECT query_id, doc_id, chunk_no, rank FROM hits"
    ),
    "R7_configurable_k": with_(*retrieval(BENCHMARK, "vector", 20, 5), body=RANKS),
    "P1_context": with_(
        *retrieval(BENCHMARK, "union"),
        HIT_TEXTS,
        context("hit_texts"),
        body="SELECT query_id, context FROM contexts",
    ),
    "P2_prompt": with_(
        *context_ctes(),
        context("kept"),
        PROMPTS,
        body=f"SELECT query_id, prompt, CAST(len({words('prompt')}) AS INTEGER) AS n_tokens FROM prompts",
    ),
    "P3_system_message": with_(
        *context_ctes(),
        context("kept"),
        PROMPTS,
        body=f"""
SELECT query_id, CAST(0 AS INTEGER) AS pos, 'system' AS role, {lit(SYSTEM_MESSAGE)} AS content FROM prompts
UNION ALL SELECT query_id, CAST(1 AS INTEGER), 'user', prompt FROM prompts""",
    ),
    "P4_context_budget": with_(
        *context_ctes(top_n=10, num_ctx=640),
        body="SELECT query_id, rank, doc_id, chunk_no, n_tokens FROM kept",
    ),
    "P5_extractive_answer": with_(
        *context_ctes(), BEST_SENTENCES, body="SELECT query_id, answer, overlap FROM best"
    ),
    "P5_generator_slot": with_(
        *context_ctes(),
        context("kept"),
        PROMPTS,
        body="SELECT query_id, 'a prompt of ' || length(prompt) || ' characters' AS answer, "
        "CAST(NULL AS VARCHAR) AS error FROM prompts",
    ),
    "P4_cut_chunk": with_(
        *[chunk_ctes(1024, 200) if cte is CHUNKS else cte for cte in context_ctes()],
        body="SELECT query_id, rank, doc_id, chunk_no, n_tokens, md5(chunk_text) AS text_md5 FROM kept",
    ),
    "P6_length_cap": with_(
        *context_ctes(),
        BEST_SENTENCES,
        body=f"SELECT query_id, {capped(8)} AS answer, overlap FROM best",
    ),
    "P7_refusal": with_(*answer_ctes(min_overlap=12), body="SELECT query_id, answer FROM answered"),
    "P8_answer": with_(
        *answer_ctes(mode="vector"),
        body="SELECT query_id, answer, CAST(NULL AS VARCHAR) AS error FROM answered",
    ),
    "P8_answer_union": with_(
        *answer_ctes(), body="SELECT query_id, answer, CAST(NULL AS VARCHAR) AS error FROM answered"
    ),
    "P9_errors_as_values": with_(
        *answer_ctes(ALL_TURNS),
        body=f"""
SELECT query_id, coalesce(answer, {lit(ERROR_PREFIX + EMPTY_QUESTION)}) AS answer,
       CASE WHEN query_text IS NULL THEN {lit(EMPTY_QUESTION)} END AS error
FROM every_turn LEFT JOIN answered USING (query_id)""",
    ),
    "P10_response": with_(*answer_ctes(mode="vector"), body="SELECT query_id, answer FROM answered"),
    "ST1_stream_ingest": INDEX_ROWS,
    "ST1_stream_append": with_(
        CHUNKS,
        GROWN_VECTORS,
        body="SELECT doc_id, chunk_no, CAST(n_terms AS INTEGER) AS n_terms, round(norm, 3) AS norm "
        "FROM lens JOIN norms USING (doc_id, chunk_no)",
    ),
    "ST1_stream_changes": with_(
        CHUNKS.replace(
            "FROM documents",
            "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed ' || text ELSE text END AS text"
            " FROM documents WHERE doc_id % 5 <> 0)",
        ),
        body="SELECT doc_id, chunk_no, n_tokens, md5(chunk_text) AS text_md5, (SELECT count(*) FROM chunks) AS points FROM chunks",
    ),
    "ST2_stream_questions": with_(*answer_ctes(USER_TURNS), body="SELECT query_id, answer FROM answered"),
    "M1_stage_metrics": with_(
        chunk_ctes(1024, 200),
        body="""
SELECT 'documents' AS stage, 'rows' AS metric, count(*)::DOUBLE AS value FROM documents
UNION ALL SELECT 'documents', 'bad', count(*) FROM doc_words WHERE len(w) = 0
UNION ALL SELECT 'chunks', 'rows', count(*) FROM chunks
UNION ALL SELECT 'chunks', 'bad', count(*) FROM chunks WHERE n_tokens < 1024""",
    ),
    "M1_stream_metrics": with_(
        chunk_ctes(1024, 200),
        body="""
SELECT 0::BIGINT AS batch, 'documents' AS stage, 'rows' AS metric, count(*)::DOUBLE AS value FROM documents
UNION ALL SELECT 0, 'documents', 'bad', count(*) FROM doc_words WHERE len(w) = 0""",
    ),
    "M2_result_quality": quality_sql(),
    "M3_answer_cache": CACHE,
}
